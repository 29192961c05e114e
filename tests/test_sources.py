import numpy as np
import pytest
from pyspark.sql import functions as F

from parapheur import cli
from parapheur.operators.pages import pages_from_lines
from parapheur.sources import files, recognition
from parapheur.streaming import ingest


def test_files_to_pages_with_a_backend_that_fails_on_one(spark, tmp_path):
    for name, text in (("doc_001_x.pdf", "De : A\nObjet : B\fpage deux"), ("doc_002_y.PNG", " "), ("notes.txt", "no"), ("doc_003_z.jpg", "bad")):
        (tmp_path / name).write_text(text, encoding="utf-8")

    class Fails(recognition.PlainTextBackend):
        def lines(self, path, content):
            if content == b"bad":
                raise RuntimeError("unreadable")
            return super().lines(path, content)

    found = files.document_files(spark, str(tmp_path))
    assert found.count() == 3 and files.document_files(spark, str(tmp_path), limit=1).first().doc_id == "doc_001"
    lines = recognition.recognised_lines(found, Fails())
    assert lines.where("error IS NOT NULL").first().doc_id == "doc_003"
    pages = {(r.doc_id, r.page): r.raw_text for r in pages_from_lines(lines.where("error IS NULL")).collect()}
    assert pages == {("doc_001", 1): "De : A\nObjet : B", ("doc_001", 2): "page deux", ("doc_002", 1): ""}  # blank lines are no text


def test_gold_csv_and_missing_results(spark, tmp_path):
    header = ",".join(files.GOLD_HEADER)
    (tmp_path / "gold.csv").write_text(f'{header}\ndoc_1_a.pdf,S,D,01/01/2024,R,O,P,"line 1\nline ""2""",C,T\n', encoding="utf-8")
    row = files.gold_csv(spark, str(tmp_path / "gold.csv")).first()
    assert row.content == 'line 1\nline "2"' and row.source == "S"
    assert files.earlier_results(spark, str(tmp_path / "none"), spark.range(1).schema).count() == 0


def test_report_files(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c_d", None)], "name STRING, f1 DOUBLE")
    out = files.export_report(df, str(tmp_path), "t")
    assert out["csv"].read_bytes().startswith(b"\xef\xbb\xbf") and "0.5000" in out["md"].read_text() and "n/a" in out["tex"].read_text() and "c\\_d" in out["tex"].read_text()
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_command_line_resumes_in_batches(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/ocr_pages.parquet").where("doc_id IS NOT NULL").select("doc_id", "page_row_id", "raw_text", "confidence").limit(12)
    pages.write.parquet(str(tmp_path / "pages"))
    cli.extract(spark, str(tmp_path / "pages"), str(tmp_path / "out"), docs=2, batch_size=1)
    part = spark.read.parquet(str(tmp_path / "out/selected"))
    assert part.select("doc_id").distinct().count() == 2
    n = part.count()
    cli.extract(spark, str(tmp_path / "pages"), str(tmp_path / "out"), resume=True)
    whole = spark.read.parquet(str(tmp_path / "out/selected"))
    assert whole.count() > n and whole.groupBy("page_row_id", "field").count().where("count > 1").isEmpty()


def test_pages_without_a_document_are_extracted_in_batches_too(spark, data, tmp_path):
    names = F.when(F.col("page_row_id") % 3 > 0, F.concat(F.lit("doc_"), F.col("page_row_id") % 3))
    pages = spark.read.parquet(f"{data}/ocr_pages.parquet").where("raw_text <> ''").select("page_row_id", "raw_text", "confidence").limit(9).withColumn("doc_id", names)
    pages.write.parquet(str(tmp_path / "pages"))

    whole = sorted((r.doc_id or "", r.page_row_id) for r in spark.read.parquet(str(tmp_path / "pages")).collect())
    named = [x for x in whole if x[0]]
    assert 0 < len(named) < len(whole)
    for options, want in (({"batch_size": 1}, whole), ({"docs": 2}, named), ({"docs": 3, "batch_size": 2}, whole)):
        cli.extract(spark, str(tmp_path / "pages"), str(tmp_path / "out"), **options)
        got = spark.read.parquet(str(tmp_path / "out/candidates")).select("doc_id", "page_row_id").distinct().collect()
        assert sorted((r.doc_id or "", r.page_row_id) for r in got) == want


def test_report_command(spark, data, tmp_path):
    cli.report(spark, f"{data}/kie_approaches.parquet", f"{data}/generated_documents.parquet", str(tmp_path / "r"))
    assert (tmp_path / "r/approach_f1.md").exists() and (tmp_path / "r/field_means.csv").exists()


def test_stream_resumes_from_its_checkpoint(spark, data, tmp_path):
    pages = spark.read.parquet(f"{data}/ocr_pages.parquet").select("page_row_id", "raw_text", "confidence").limit(10)
    pages.repartition(2).write.parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.page_stream(spark, str(tmp_path / "in"), pages.schema, files_per_batch=1)
        ingest.extract_incrementally(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    first = run()
    assert first.select("batch").distinct().count() == 2
    assert run().count() == first.count()


def test_running_means_stream(spark, data, tmp_path):
    rows = spark.read.parquet(f"{data}/kie_approaches.parquet").select("field_name", "f1", "evaluated_at")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    ingest.running_field_means(stream, "means_so_far", str(tmp_path / "cp")).awaitTermination()
    want = {r.field_name: round(r.m, 9) for r in rows.groupBy("field_name").agg(F.avg("f1").alias("m")).collect()}
    assert {r.field_name: round(r["mean"], 9) for r in spark.table("means_so_far").collect()} == want
    windows = ingest.event_windows(stream, "evaluated_at")
    assert windows.isStreaming and set(windows.columns) == {"window", "field_name", "n", "f1"}


def test_image_steps():
    white = np.full((80, 120, 3), 255, np.uint8)
    assert recognition.is_digital(white) and recognition.preprocessed(white).shape == white.shape
    page = np.full((120, 160), 255, np.uint8)
    for k in range(5):
        for x in range(160):
            y = 20 + 15 * k + round(np.tan(np.radians(3)) * x)
            page[y : y + 2, x] = 0
    assert abs(recognition.skew_angle(page) - 3) <= 0.5 and abs(recognition.skew_angle(recognition.deskew(page))) <= 0.5
    rng = np.random.default_rng(1)
    noisy = np.clip(150 + rng.normal(0, 12, (40, 40)), 0, 255).astype(np.uint8)
    assert recognition.denoise(noisy).std() < noisy.std()
    spot = np.full((50, 50), 200, np.uint8)
    spot[20:24, 20:24] = 20
    assert (recognition.threshold(spot)[20:24, 20:24] == 0).all() and recognition.threshold(spot)[0, 0] == 255
    assert not recognition.looks_handwritten(spot) and recognition.skew_angle(np.full((9, 9), 255)) == 0.0


@pytest.mark.parametrize("angle", [-40, -8, -0.2, 0, 3, 8, 20, 44])
def test_skew_of_any_angle_up_to_45(angle):
    yy, xx = np.mgrid[:420, :600].astype(float)
    t = np.radians(angle)
    u, v = np.cos(t) * (xx - 300) + np.sin(t) * (yy - 210), np.cos(t) * (yy - 210) - np.sin(t) * (xx - 300)
    page = np.where((np.abs(u) < 160) & (np.abs(v) < 100) & (np.mod(v, 20) < 8) & (np.mod(u, 9) < 6), 0, 255).astype(np.uint8)
    want = 0 if abs(angle) < 0.5 else angle
    assert abs(recognition.skew_angle(page) - want) <= 0.3
    upright = recognition.deskew(page)
    assert recognition.skew_angle(upright) == 0.0 and recognition.deskew(np.dstack([page] * 3)).shape == (420, 600, 3)
    assert ((upright < 128).sum(axis=1) == 0).sum() > 420 - 10 * 12  # rows between the lines are free of ink again


def test_an_even_block_is_not_turned():
    page = np.full((300, 200), 255, np.uint8)
    page[20:280, 15:185] = 0
    assert recognition.skew_angle(page) == 0.0


def _slow_means(g, strength, template, search):
    """Non-local means by the definition, pixel by pixel."""
    r, s = template // 2, search // 2
    pad = np.pad(g.astype(float), r + s, mode="reflect")
    out = np.empty(g.shape)
    for y, x in np.ndindex(*g.shape):
        a, b = y + r + s, x + r + s
        mine = pad[a - r : a + r + 1, b - r : b + r + 1]
        total = weight = 0.0
        for c in range(a - s, a + s + 1):
            for d in range(b - s, b + s + 1):
                w = np.exp(-((mine - pad[c - r : c + r + 1, d - r : d + r + 1]) ** 2).mean() / strength**2)
                if w >= 0.001:
                    total, weight = total + w * pad[c, d], weight + w
        out[y, x] = total / weight
    return out


def test_denoise_windows():
    g = np.random.default_rng(2).integers(100, 125, (14, 17)).astype(np.uint8)
    assert np.abs(recognition.denoise(g) - _slow_means(g, 10, 7, 21)).max() <= 0.51
    assert np.abs(recognition.denoised_for_tables(g) - _slow_means(g, 5, 7, 15)).max() <= 0.51


def test_digital_pages_by_statistics(spark):
    rows = [("d", 1, 2, 2, 1, bytearray([255] * 4)), ("d", 2, 1, 2, 3, bytearray([0, 0, 0, 255, 255, 255]))]
    stats = recognition.page_statistics(spark.createDataFrame(rows, "doc_id STRING, page INT, height INT, width INT, channels INT, data BINARY"))
    out = {r.page: r.d for r in stats.select("page", recognition.digital(F.col("mean"), F.col("std")).alias("d")).collect()}
    assert out == {1: True, 2: False}


def test_layout_and_fallback(spark):
    boxes = spark.createDataFrame([("d", 1, "Text", [0]), ("d", 1, "Table", [1]), ("d", 1, None, [2])], "doc_id STRING, page INT, label STRING, bbox ARRAY<INT>")
    row = recognition.layout_regions(boxes).first()
    assert row.tables == [[1]] and row.text == [[0]]
    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id STRING, page INT")
    first = pages.where("page = 1").withColumn("method", F.lit("a"))
    both = recognition.with_fallback(first, pages, lambda p: p.withColumn("method", F.lit("b")))
    assert {(r.page, r.method) for r in both.collect()} == {(1, "a"), (2, "b")}


def test_stamps_are_found_and_lines_are_not():
    yy, xx = np.mgrid[:220, :300]
    page = np.full((220, 300), 255.0)
    page[np.abs(np.hypot(xx - 90, yy - 100) - 45) < 2.5] = 40
    page[150:153, 10:290] = 0
    found = recognition.stamps(page, largest=70)
    assert len(found) == 1 and np.hypot(found[0][0] - 90, found[0][1] - 100) <= 3 and abs(found[0][2] - 45) <= 4
    assert recognition.stamps(np.full((60, 60), 255.0), largest=30) == []
