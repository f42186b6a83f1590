"""Defined cases of the core operators: nulls, ties, repeated rows, empty tables, extra columns; and what raises."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from holdfast.functions import rules
from holdfast.operators import audits, graph, joins, metrics, splits
from holdfast.scratch import new_path
from holdfast.sources import readers, sinks
from holdfast.streaming import ingest


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_diagnosis_falls_through(spark):
    t = frame(spark, [("NL", "2", None), ("12", "emci", None), (None, None, "1"), ("ad", None, None), ("", " ", "0")], "diagnosis string, dxcurren string, dxad string")
    got = [tuple(r.x) for r in t.select(rules.diagnosis(t).alias("x")).collect()]
    assert got == [("MCI", "DXCURREN", "clinical_table"), ("MCI", "DXCURREN", "clinical_table"), ("AD", "DXAD", "clinical_table"), ("AD", "DIAGNOSIS", "clinical_table"), ("unknown", "", "missing")]
    none = frame(spark, [(1,)], "other int")
    assert tuple(none.select(rules.diagnosis(none).alias("x")).first().x) == ("unknown", "", "missing")


def test_rules_that_raise(spark):
    for column, value in ((rules.label_from_rating(F.col("v")), "-1"), (rules.session_subject(F.col("v")), "OAS2_0001_MR1"), (joins.disc_of(F.col("v")), "OAS1_0999_MR1"), (rules.session_subject(F.col("v")), None)):
        with pytest.raises(Exception, match="negative rating|unsupported session|no disc"):
            frame(spark, [(value,)], "v string").select(column).collect()
    with pytest.raises(ValueError):
        rules.split_part("split", "other")
    ok = frame(spark, [("OAS1_0080_MR2",), ("OAS1_0080_MR1",)], "v string").select(joins.disc_of(F.col("v")).alias("d")).collect()
    assert [r.d for r in ok] == [3, 2]


def test_intensity_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    t = frame(spark, [([nan, inf, 1.0, 2.0, 3.0, None],), ([0.0, -1.0],), ([],), (None,), ([5.0],)], "v array<double>")
    got = [r.x for r in t.select(rules.normalise_intensity(F.col("v")).alias("x")).collect()]
    assert got[0][:2] == [0.0, 0.0] and got[0][4] == 255.0 and got[0][5] == 0.0
    assert got[1] == [0.0, 0.0] and got[2] == [] and got[3] is None and got[4] == [0.0]


def test_nearest_defined_cases(spark):
    left = frame(spark, [("a", 1, "2020-01-10"), ("a", 1, "2020-01-10"), (None, 2, "2020-01-10"), ("a", 3, None), ("b", 4, "2020-01-10")], "k string, id int, d string").withColumn("d", F.to_date("d")).withColumn("_day", F.lit("x"))
    right = frame(spark, [("a", "2020-01-12", 1, "late"), ("a", "2020-01-08", 3, "second"), ("a", "2020-01-08", 2, "early"), (None, "2020-01-10", 4, "null"), ("b", None, 5, "undated")], "k string, x string, o int, v string").withColumn("x", F.to_date("x"))
    got = sorted((r.id, r.v, r.gap_days) for r in joins.nearest(left, right, "k", "id", "d", "x", "o", 180, ["v"]).collect())
    assert got == [(1, "early", 2), (1, "early", 2), (2, None, None), (3, None, None), (4, None, None)]
    assert joins.nearest(left, right.where("false"), "k", "id", "d", "x", "o", 180, ["v"]).where("v is not null").count() == 0
    assert joins.nearest(left.where("false"), right, "k", "id", "d", "x", "o", 180, ["v"]).count() == 0


def test_lookups_keep_rows(spark):
    left = frame(spark, [(1, "a"), (2, None), (2, None)], "id int, k string")
    twice = frame(spark, [("a", "x"), ("a", "y"), (None, "z")], "k string, value string")
    got = sorted((r.id, r.value, r.value_source) for r in joins.cascade(left, [("one", twice, ["k"])], "value").collect())
    assert got == [(1, "y", "one"), (2, None, "none"), (2, None, "none")]
    with pytest.raises(Exception, match="exactly one row"):
        joins.required_join(left, twice, "k").collect()
    late = frame(spark, [("k", 1, "a"), ("k", 1, "b"), (None, 2, "c"), ("n", None, "d")], "key string, ord int, v string")
    assert sorted((r.key or "", r.v) for r in joins.latest_per_key(late, ["key"], "ord").collect()) == [("", "c"), ("k", "b"), ("n", "d")]
    assert [tuple(r) for r in joins.superset(left.select("k"), left.select("k")).collect()] == [(True, 0)]
    ages = frame(spark, [("a", "71.5"), ("a", "70"), ("b", "?")], "k string, age string")
    assert [tuple(r) for r in joins.with_numeric(left, ages, "k", "age").collect()] == [("a", 1, 70.0)]


def test_grids_and_splits_that_raise(spark):
    found, axis = frame(spark, [(1, "x")], "seed int, p string"), frame(spark, [(1,), (2,)], "seed int")
    with pytest.raises(ValueError, match="missing cells"):
        joins.require_complete(found, [axis, found.select("p")])
    assert joins.require_complete(found, [found.select("seed"), found.select("p")]) is found
    rows = frame(spark, [("s", "train", "A"), ("s", "test", "B"), (None, "train", "A"), (None, "test", "A")], "subject string, split string, label string")
    with pytest.raises(ValueError, match="subject train/test: 1"):
        splits.require_no_overlap(rows, ["subject"])
    with pytest.raises(ValueError, match="components of several labels: s"):
        splits.require_pure(rows, "subject", "label")
    clean = rows.where("subject is null")
    assert splits.require_no_overlap(clean, ["subject"]) is clean


def test_groups_keep_rows_without_a_key(spark):
    rows = frame(spark, [(i, None if i % 3 == 0 else f"g{i % 5}") for i in range(60)], "id int, g string").withColumn("position", F.lit(1))
    out = splits.group_split(rows, "g", 1)
    assert out.count() == 60 and out.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n <> 1").count() == 0
    repeated = rows.unionByName(rows)
    assert splits.random_split(repeated, "id", 3).count() == 120
    ranks = [r.position for r in splits.positions(frame(spark, [(None,), ("ab",), ("ab",), ("ff",)], "k string"), F.col("k")).orderBy("position").collect()]
    assert ranks == [1, 2, 3, 4]
    numbers = frame(spark, [(7,), (-3,), (10**12,), (8,)], "n long")
    assert [(r.n, r.position) for r in splits.ordinal_positions(numbers, "n").orderBy("position").collect()] == [(-3, 1), (7, 2), (8, 3), (10**12, 4)]
    assert splits.ordinal_positions(numbers.where("false"), "n").count() == 0


def test_ordinals_beyond_five_digits(spark):
    members = spark.range(100_002).select((F.col("id") * 3).alias("component"))
    got = graph.ordinal_ids(members.unionByName(members), prefix="100%_")
    assert got.count() == 100_002 and got.select("ordinal").distinct().count() == 100_002
    few = got.where(F.col("component").isin(0, 299_997, 300_000, 300_003))
    assert {r.component: r.ordinal for r in few.collect()} == {0: "100%_00000", 299_997: "100%_99999", 300_000: "100%_100000", 300_003: "100%_100001"}


def _manifest(spark, donors, scans, test):
    rows = [(f"d{s}_{k}", f"d{s}", f"2020-01-{k + 1:02d}", "CN" if s % 2 else "AD", "train") for s in range(donors) for k in range(scans)]
    rows += [(f"t{i}", f"t{i}", "2020-02-01", "CN" if i % 2 else "AD", "test") for i in range(test)]
    return frame(spark, [*rows, ("v", "v", "2020-03-01", "MCI", "val"), ("o", "o", "2020-03-01", "MCI", "test")], "image_id string, subject_id string, acq_date string, label string, split string")


def test_donors_give_several_scans_at_full_share(spark):
    rows = _manifest(spark, 5, 10, 20)
    out = splits.inject_leakage(rows, 1.0, 4).collect()
    moved = [r for r in out if r.injected]
    assert len(moved) == 20 and sum(r.split == "test" for r in out) == 21 and len(out) == rows.count() - 20
    by = {}
    for r in moved:
        by.setdefault(r.subject_id, []).append(r.acq_date)
    assert all(sorted(days) == [f"2020-01-{k + 1:02d}" for k in range(len(days))] for days in by.values()) and len(by) == 5
    audit = splits.injection_audit(rows, splits.inject_leakage(rows, 1.0, 4), 1.0).first()
    assert (audit.actual, audit.n_overlap, audit.n_donors_used, audit.before_CN, audit.after_CN, audit.n_val) == (1.0, 20, 5, 10, 10, 1)


def test_donor_shortage_below_full_share(spark):
    rows = _manifest(spark, 5, 10, 20)
    out = splits.inject_leakage(rows, 0.9, 4)
    assert out.where("injected").count() == 5 and out.where("injected").select("subject_id").distinct().count() == 5
    assert splits.inject_leakage(_manifest(spark, 5, 1, 20), 0.5, 4).where("injected").count() == 0
    assert splits.inject_leakage(rows, 0.01, 4).drop("injected").exceptAll(rows).count() == 0


def test_reports_on_empty_tables(spark):
    empty = frame(spark, [], "s string, split string, label string, id int, v double")
    assert audits.group_counts(empty, "s").count() == 0 and [tuple(r) for r in audits.missingness(empty, ["s"]).collect()] == [("s", 0)]
    assert {r.gate: r.passed for r in audits.gates(empty, "split", "s", "label").collect()} == {"has_rows": False, "has_classes": False, "no_contamination": True, "all_splits": False}
    assert audits.spread(empty, ["s"], "v").count() == 0 and splits.share_drift(empty, "split", "label").count() == 0
    assert joins.near_counts(joins.near_hashes(frame(spark, [(1, None)], "id int, w array<bigint>"), "id", "w"), joins.hash_classes(frame(spark, [(1, None)], "id int, w array<bigint>"), "id", "w")).count() == 0
    assert graph.key_components(empty, "id", "s").count() == 0
    some = frame(spark, [("a", 1.0), ("a", float("nan")), ("b", None)], "s string, v double")
    assert sorted((r.s, r.n, r.mean, r.sd) for r in audits.spread(some, ["s"], "v").collect()) == [("a", 1, 1.0, 0.0), ("b", 0, None, 0.0)]


def test_stratified_top_up(spark):
    rows = frame(spark, [(i, "a" if i < 3 else "b" if i < 50 else "z") for i in range(60)], "id int, label string")
    got = splits.stratified_limit(rows, "label", "id", 20, 1, ("b", "a")).collect()
    assert len(got) == 20 and sum(r.label == "a" for r in got) == 3 and sum(r.label == "b" for r in got) >= 10
    assert splits.stratified_limit(rows, "label", "id", 60, 1, ("a", "b")).count() == 60


def test_relabel_ties_and_excluded(spark):
    rows = frame(spark, [(1, "c", "mixed_label", "AD"), (2, "c", "mixed_label", "CN"), (3, "m", "mixed_label", "MCI"), (4, "n", None, "CN")], "id int, comp string, component_label string, label string")
    out = splits.relabel_by_majority(rows, "comp", "component_label", "label", "id")
    assert {r.id: r.component_label for r in out.collect()} == {1: "AD", 2: "AD", 3: "mixed_label", 4: None}
    assert sorted(r.id for r in splits.excluded(out, "component_label").collect()) == [3, 4]


def test_probe_blocks(spark):
    rows = frame(spark, [(g, [float(g), float(g * g)], f) for g in range(30) for f in ("fit", "probe")], "g int, v array<double>, fold string")
    for block in (256, 4):
        r = metrics.centroid_probe(rows, "g", "v", "fold", block).first()
        assert r.accuracy == 1.0 and r.lift == pytest.approx(30.0)


def test_archives(spark, tmp_path):
    zips = tmp_path / "a.b.zip"
    with zipfile.ZipFile(zips, "w") as z:
        z.writestr("x/one.csv", "a,b\n1,2\n")
        z.writestr("two.csv", "c" * 3_000_000)
    target = str(tmp_path / "out")
    assert readers.extract_zip(spark, str(zips), target) == (2, 0, False)
    assert (tmp_path / "out/x/one.csv").read_text() == "a,b\n1,2\n" and (tmp_path / "out/two.csv").stat().st_size == 3_000_000
    assert readers.extract_zip(spark, str(zips), target) == (0, 0, True)
    (tmp_path / "out/two.csv").unlink()
    assert readers.extract_zip(spark, str(zips), target) == (1, 1, False)
    bad = tmp_path / "bad.zip"
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../evil.txt", "x")
    with pytest.raises(ValueError, match="suspicious"):
        readers.extract_zip(spark, str(bad), str(tmp_path / "bad"))
    assert not (tmp_path / "bad/ok.txt").exists()
    assert readers.destination("study_files", "/d/a.b.zip", "/i", "/t/") == "/t/a.b" and readers.destination("mixed", "z.zip", "/i", "/t") == "/i/z"
    tar = tmp_path / "d.tar"
    with tarfile.open(tar, "w") as t:
        for name in ("n3.hdr", "n4.img", "other"):
            info = tarfile.TarInfo(name)
            info.size = 4
            t.addfile(info, io.BytesIO(b"data"))
    wanted = {"n3.hdr": str(tmp_path / "v.hdr"), "n4.hdr": str(tmp_path / "v.hdr"), "n4.img": str(tmp_path / "v.img"), "gone": str(tmp_path / "gone")}
    assert readers.extract_tar(spark, str(tar), wanted) == ({"n3.hdr", "n4.img"}, [str(tmp_path / "gone")])
    assert (tmp_path / "v.img").read_bytes() == b"data"


def test_files(spark, tmp_path):
    (tmp_path / "cls").mkdir()
    (tmp_path / "cls/A (3).JPG").write_bytes(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x11\x00\x22\x01\x01\x11\x00")
    (tmp_path / "cls/b.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"\x00\x00\x00\rIHDR" + (7).to_bytes(4, "big") + (5).to_bytes(4, "big"))
    (tmp_path / "cls/bad.jpeg").write_bytes(b"nothing")
    (tmp_path / "big.bin").write_bytes(b"x" * 200_000)
    (tmp_path / "none").write_bytes(b"")
    sizes = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.width, r.height) for r in readers.image_sizes(spark, str(tmp_path)).collect()}
    assert sizes == {"A (3).JPG": (34, 17), "b.png": (7, 5), "bad.jpeg": (None, None)}
    assert [r["class"] for r in readers.list_images(spark, str(tmp_path)).collect()] == ["cls"] * 3
    found = {r.relative_path: (r.suffix, r.sha256) for r in readers.inventory(spark, str(tmp_path), max_hash_mb=0.1).collect()}
    assert found["big.bin"] == (".bin", "skipped_large_file") and found["none"][0] == "[none]" and len(found) == 5
    (tmp_path / "sparse.zip").touch()
    with open(tmp_path / "sparse.zip", "r+b") as f:
        f.truncate(3 * 2**30)  # larger than a row can hold; takes no disk
    assert {r.relative_path: r.sha256 for r in readers.inventory(spark, str(tmp_path), 10_000).collect()}["sparse.zip"] == "skipped_large_file"
    assert readers.find_table(spark, str(tmp_path / "cls"), ["zzz", "b."]).endswith("b.png")


def test_csv_and_workbook(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("Näme ,V 1\n café ,x\n".encode("latin-1"))
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfRID,X\n1, \n2,b,c\n")
    (tmp_path / "empty.csv").write_bytes(b"a,b\n")
    assert [r.asDict() for r in readers.read_csv_safely(spark, str(tmp_path / "latin.csv")).collect()] == [{"näme": "café", "v_1": "x"}]
    assert [tuple(r) for r in readers.read_csv_safely(spark, str(tmp_path / "bom.csv")).select("rid", "x").collect()] == [("1", None), ("2", "b")]
    assert readers.read_csv(spark, str(tmp_path / "empty.csv"), {"a"}).count() == 0
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    book = tmp_path / "w.xlsx"
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>ID</t></si><si><t>Age</t></si><si><r><t>OAS1</t></r><r><t>_0001_MR1</t></r></si></sst>")
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2"><v>74</v></c></row><row><c r="C3"><v>9</v></c></row><row><c r="A4" t="inlineStr"><is><t>x</t></is></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{cells}</sheetData></worksheet>")
    got = readers.read_workbook(spark, str(book))
    assert got.columns == ["ID", "column_2", "Age"] and [tuple(r) for r in got.collect()] == [("OAS1_0001_MR1", None, "74"), ("x", None, None)]


def test_rendered_tables(spark):
    t = frame(spark, [("a|b", "50% of $x_{1}^2 & #~\\", None)], "n string, v string, z int")
    assert sinks.to_markdown(t).split("\n")[-1] == "| a\\|b | 50% of $x_{1}^2 & #~\\\\ |  |"
    assert r"50\% of \$x\_\{1\}\textasciicircum{}2 \& \#\textasciitilde{}\textbackslash{}" in sinks.to_latex(t)
    report = sinks.audit_report("Audit", {"rows": t}, frame(spark, [("one", True), ("two", False)], "gate string, passed boolean"))
    assert report.startswith("# Audit") and report.rstrip().endswith("FAIL: two")
    assert sinks.to_json(t.select("z")) == '[\n  {\n    "z": null\n  }\n]'


def test_streams_equal_their_batch_form(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    root, out, mark = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-mark"))
    events.limit(300).unionByName(events.limit(300)).repartition(3).write.parquet(root)
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    for _ in range(2):  # a second run adds nothing
        ingest.ingest(spark, root, schema, "ts", "event_id", out, mark, "3650 days").awaitTermination(120)
    assert spark.read.schema(schema).parquet(out).count() == 300
    rows = spark.readStream.schema(schema).parquet(root)

    def run(stream, mode, name):
        q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", new_path(spark, name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    batch = spark.read.schema(schema).parquet(root)
    counts = batch.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    assert run(ingest.windowed_counts(rows, "ts", "event_type"), "complete", "windows") == sorted(map(tuple, counts.collect()), key=str)
    gate = batch.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).where("n > 1").select("user_id")
    assert run(ingest.online_gate(rows, "user_id", "event_type"), "complete", "gate") == sorted(map(tuple, gate.collect()), key=str)
