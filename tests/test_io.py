"""Readers, sinks and streams."""

from __future__ import annotations

import json
import zipfile
from datetime import datetime, timedelta

import numpy as np

from quagmark.sources import readers
from quagmark.streaming import live

T0 = datetime(2024, 1, 1)


def test_weather_file_with_status_codes(spark, tmp_path):
    (tmp_path / "w.csv").write_bytes("Łeba;x,2020,1,5,\"1,5\",,3.0,8,7.0,9\n".replace("Łeba;x", "Łeba").encode("cp1250"))
    df = readers.weather_csv(spark, str(tmp_path / "w.csv"), ["name", "y", "m", "d", "a", "a_status", "b", "b_status", "c", "c_status"])
    r = df.first()
    assert (r.name, r.a, r.b, r.c) == ("Łeba", 1.5, None, 0.0)


def test_columnar_json(spark):
    t = json.dumps({"hourly": {"time": ["2022-01-01T00:00", "2022-01-01T01:00"], "temperature_2m": [18.2, None]}})
    rows = readers.columnar_json(spark.createDataFrame([(t,)], "j string"), "j", "hourly", "time", ["temperature_2m"]).collect()
    assert [(r.time, r.temperature_2m) for r in rows] == [(datetime(2022, 1, 1), 18.2), (datetime(2022, 1, 1, 1), None)]


def test_feature_collection(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "bog"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}, {"type": "Feature", "properties": {"name": "P1"}, "geometry": {"type": "Point", "coordinates": [2.5, 3]}}]}
    (tmp_path / "a.geojson").write_text(json.dumps(f))
    rows = {r.name: r for r in readers.feature_collection(spark, str(tmp_path / "a.geojson")).collect()}
    assert len(rows["bog"].rings[0]) == 4 and rows["P1"].rings == [[[2.5, 3.0]]]


def test_sheet_index(spark):
    xml = "<c><m><ms:Sheet fid='1'><ms:godlo>A-1</ms:godlo><ms:rok>2020</ms:rok></ms:Sheet></m><m><ms:Sheet><ms:godlo>A-2</ms:godlo></ms:Sheet></m></c>"
    got = [r.fields for r in readers.sheet_index(spark.createDataFrame([(xml,)], "x string"), "x", "Sheet").collect()]
    assert got == [{"godlo": "A-1", "rok": "2020"}, {"godlo": "A-2"}]


def test_raster_sources(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    got = {(r.row, r.col): r.value for r in readers.ascii_grids(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): 4.0}
    np.array([[1, 2, 3], [4, 5, 6]], "<f4").tofile(tmp_path / "d.ztd")
    (tmp_path / "d.ztd.rsc").write_text("WIDTH 3\nFILE_LENGTH 2\n")
    got = {(r.row, r.col): r.value for r in readers.raw_floats(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[(1, 2)] == 6.0


def test_logger_and_stores(spark, tmp_path):
    (tmp_path / "l.csv").write_text("TIMESTAMP,WTD_CL\n2022-06-01 01:00:00,-3.5\n2022-06-01 02:00:00,NAN?\n")
    rows = readers.logger_csv(spark, str(tmp_path / "l.csv"), "TIMESTAMP").orderBy("time_utc").collect()
    assert rows[0].time_utc == datetime(2022, 6, 1, 0, 30) and rows[0].WTD_CL == -3.5 and rows[1].WTD_CL is None
    readers.store(spark.createDataFrame([(1, "a"), (2, "b")], "x int, p string"), str(tmp_path / "out"), ["p"])
    assert spark.read.parquet(str(tmp_path / "out")).where("p = 'b'").first().x == 2
    (tmp_path / "pairs" / "one").mkdir(parents=True)
    (tmp_path / "pairs" / "one" / "ok").touch()
    (tmp_path / "pairs" / "two").mkdir()
    assert readers.complete_folders(spark, str(tmp_path / "pairs")) == ["one"]


def test_numpy_archives(spark, tmp_path):
    np.savez(tmp_path / "scene.npz", ndvi=np.array([[0.5, np.nan]]), ok=np.array([[True], [False]]), name=np.array("x"))
    got = {(r.name, r.row, r.col): r.value for r in readers.scene_arrays(spark, str(tmp_path)).collect()}
    assert got == {("ndvi", 0, 0): 0.5, ("ndvi", 0, 1): None, ("ok", 0, 0): 1.0, ("ok", 1, 0): 0.0}


def test_workbook_cells_and_their_colours(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    link = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {link}><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="q" Target="worksheets/one.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>depth</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><fills><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00AA11"/></patternFill></fill></fills><cellXfs><xf fillId="0"/><xf fillId="1"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1" t="inlineStr"><is><t>flag</t></is></c></row><row r="2"><c r="A2"><v>3.5</v></c><c r="AB2" t="s" s="1"><v>1</v></c></row><row r="3"><c r="A3" s="1"/></row></sheetData></worksheet>')
    cells = readers.workbook_cells(spark, str(tmp_path))
    assert {(r.row, r.col, r.value, r.fill) for r in cells.collect()} == {(1, 1, "depth", None), (1, 28, "flag", None), (2, 1, "3.5", None), (2, 28, "ab", "FF00AA11"), (3, 1, None, "FF00AA11")}
    assert {(r.row, r.column) for r in readers.flagged_cells(cells, "FF00AA11").collect()} == {(0, "flag"), (1, "depth")}


def test_motion_points_and_catalogue_items(spark, tmp_path):
    (tmp_path / "m.csv").write_text("pid,latitude,longitude,20200103,20200109\nA,52.1,17.2,1.5,\nB,52.2,17.3,0,-2.5\n")
    got = {(r.pid, str(r.date)): r.mm for r in readers.motion_points(spark, str(tmp_path / "m.csv")).collect()}
    assert got == {("A", "2020-01-03"): 1.5, ("A", "2020-01-09"): None, ("B", "2020-01-03"): 0.0, ("B", "2020-01-09"): -2.5}
    text = '{"features": [{"id": "s1", "bbox": [1, 2, 3, 4], "properties": {"datetime": "2024-05-01T10:00:00Z", "eo:cloud_cover": 12.5}, "assets": {"red": {"href": "r.tif", "raster:bands": [{"scale": 0.5, "offset": -0.25}]}, "map": {"href": "m.tif"}}}]}'
    items = {r.asset: r for r in readers.catalogue_items(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()}
    assert (items["red"].scale, items["red"].offset, items["map"].scale, items["map"].offset) == (0.5, -0.25, 1.0, 0.0) and items["map"].bbox == [1, 2, 3, 4] and items["red"].datetime == datetime(2024, 5, 1, 10)


def test_json_has_no_nan(spark):
    df = spark.createDataFrame([(1, float("nan"), [1.0, float("inf")], T0.date())], "i int, x double, v array<double>, d date")
    assert readers.json_lines(df).first().json == '{"i":1,"x":null,"v":[1.0,null],"d":"%s"}' % T0.date().isoformat()


def test_manifest(spark, tmp_path):
    readers.manifest(spark, f"{tmp_path}/run/m.json", rows=3, name="ż")
    assert json.loads((tmp_path / "run" / "m.json").read_text()) == {"rows": 3, "name": "ż"}


def drain(q):
    q.awaitTermination()


def test_stream_of_pairs_keeps_its_chain_between_batches(spark, tmp_path):
    d = [T0 + timedelta(days=i) for i in range(6)]
    schema = "k string, t1 timestamp, t2 timestamp, est double"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", d[0], d[1], 1.0), ("a", d[1], d[2], 2.0)], schema).coalesce(1).write.parquet(src)
    spark.createDataFrame([("a", d[2], d[3], 4.0), ("a", d[4], d[5], 8.0)], schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
    drain(live.chained(s, "k", "t1", "t2", "est").writeStream.format("memory").queryName("chained_test").outputMode("append").trigger(availableNow=True).start())
    assert sorted((r.seg, r.level) for r in spark.table("chained_test").collect()) == [(0, 1.0), (0, 3.0), (0, 7.0), (1, 8.0)]


def test_intake_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "id int, v string").write.parquet(src)
    read = lambda: spark.readStream.schema("id int, v string").parquet(src)
    drain(live.take_in(read(), out, "id", str(tmp_path / "c1")))
    drain(live.take_in(read(), out, "id", str(tmp_path / "c2")))
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2]
