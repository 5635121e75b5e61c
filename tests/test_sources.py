"""Sources, sinks and streaming jobs on small files."""

import json

from pyspark.sql import functions as F

from plumbline.operators import gate
from plumbline.sources import files
from plumbline.streaming import jobs

CODE = b'''
from shelves import Shelf

class Library(Building):
    def __init__(self, shelf: Shelf):
        self.shelf = shelf

    def lend(self, book: Book) -> int:
        """doc"""
        return self.shelf.take(book)
'''


def _facts(spark, *contents):
    df = spark.createDataFrame([("p", i, "a.py", bytearray(c)) for i, c in enumerate(contents)], "project string, version long, file_path string, content binary")
    return files.structure_hash(files.extract_facts(df)).orderBy("version").collect()


def test_fact_extraction_and_structure_hash(spark):
    a, comment, other, broken = _facts(spark, CODE, CODE.replace(b'"""doc"""', b'"""other words"""  # more'), CODE.replace(b"lend(self, book: Book)", b"lend(self)"), b"def (")
    assert a.classes[0]["name"] == "Library" and a.classes[0]["fields"][0].asDict() == {"name": "shelf", "type": "Shelf"}
    lend = a.classes[0]["methods"][1]
    assert lend["name"] == "lend" and lend["call_refs"][0].asDict() == {"name": "take", "receiver": "self.shelf", "instantiation": False}
    assert a.structure_hash == comment.structure_hash != other.structure_hash and a.text_sha256 != comment.text_sha256
    assert broken.parse_error


def test_source_scan(spark, tmp_path):
    for name in ("a.py", "node_modules/b.js", ".git/c.py", "src/d.ts", "notes.txt", "e.go"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {r.path.rsplit("/", 1)[1]: r.language for r in files.scan_sources(spark, str(tmp_path)).collect()}
    assert found == {"a.py": "python", "d.ts": "typescript"}
    assert [r[0] for r in files.unsupported_extensions(spark, str(tmp_path)).collect()] == ["go"]
    assert files.file_inventory(spark, str(tmp_path), 2).count() == 2


DESIGN = {
    "_type": "Project", "_id": "0", "ownedElements": [
        {"_type": "UMLClass", "_id": "1", "name": "Library", "attributes": [{"_type": "UMLAttribute", "_id": "a", "name": "shelf", "type": {"$ref": "2"}}],
         "operations": [{"_type": "UMLOperation", "_id": "o", "name": "lend", "parameters": [{"_type": "UMLParameter", "_id": "r", "direction": "return", "type": "bool"}]}],
         "ownedElements": [{"_type": "UMLAssociation", "_id": "5", "end1": {"reference": {"$ref": "1"}}, "end2": {"reference": {"$ref": "2"}}}, {"_type": "UMLRealization", "_id": "6", "source": {"$ref": "1"}, "target": {"$ref": "3"}}]},
        {"_type": "UMLClass", "_id": "2", "name": "Shelf"}, {"_type": "UMLInterface", "_id": "3", "name": "Lends"}, {"_type": "UMLClass", "_id": "4", "name": " "}, {"_type": "UMLClass", "_id": "7", "name": "Shelf"}]}


def test_design_documents(spark, tmp_path):
    (tmp_path / "b.mdj").write_text(json.dumps(DESIGN))
    (tmp_path / "a.mdj").write_text("{not json")
    read = files.read_designs(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.status for r in read.select("path", "status").collect()} == {"a.mdj": "malformed", "b.mdj": "ok"}
    assert files.active_designs(read.withColumn("project", F.lit(1)), "project").first().path.endswith("a.mdj")
    nodes = files.flatten_designs(spark.createDataFrame([("d", json.dumps(DESIGN)), ("x", "{")], "doc string, text string"))
    assert sorted((r.element, r.element_type, r.node_id) for r in files.design_elements(nodes).collect()) == [("Lends", "interface", "3"), ("Library", "class", "1"), ("Shelf", "class", "2")]
    assert sorted((r.member, r.member_kind, r.type) for r in files.design_members(nodes).collect()) == [("lend", "method", "bool"), ("shelf", "attribute", "Shelf")]
    assert sorted((r.source, r.target, r.relation) for r in files.design_relations(nodes).collect()) == [("Library", "Lends", "realization"), ("Library", "Shelf", "association")]
    more = files.design_relations(nodes).unionByName(spark.createDataFrame([("d", "Library", t, r, p) for t, r, p in (("Hall", "generalization", 90), ("House", "generalization", 80), ("Lends", "realization", 95), ("Opens", "realization", 99))], "doc string, source string, target string, relation string, pos long"))
    folded = {r.element: (r.extends, r.implements) for r in files.fold_relations(files.design_elements(nodes), more).collect()}
    assert folded == {"Library": ("House", ["Lends", "Opens"]), "Shelf": (None, []), "Lends": (None, [])}
    documents = spark.createDataFrame([("d", json.dumps(DESIGN)), ("x", "{"), ("e", "[]")], "doc string, text string")
    assert sorted((r.doc, r.warning, r.name or "") for r in files.design_warnings(documents, nodes).collect()) == [("d", "repeated name", "Shelf"), ("d", "unnamed element", ""), ("e", "no elements", ""), ("x", "malformed", "")]
    assert {r.doc: tuple(r)[1:] for r in files.screen_designs(documents, nodes).collect()} == {"d": (3, 2, 2, False), "x": (0, 0, 0, True), "e": (0, 0, 0, True)}
    told = files.design_status(spark.createDataFrame([(1,), (2,), (3,)], "project int"), read.withColumn("project", F.when(F.col("status") == "ok", 1).otherwise(2)))
    assert {r.project: (r.status, r.design_hash if r.status != "ok" else "") for r in told.collect()} == {1: ("ok", ""), 2: ("error", "error"), 3: ("none", "none")}


def test_ledger_round_trip_and_merge(spark, tmp_path):
    lines = [json.dumps({"gate_strategy": "structural", "commit_index": i, "timestamp": f"2024-01-0{i + 1}T00:00:00"}) for i in range(3)] + ["", '{"gate_strategy": "str']
    (tmp_path / "proj").mkdir()
    (tmp_path / "proj/runs.jsonl").write_text("\n".join(lines))
    got = files.read_ledger(spark, str(tmp_path), newest=2).collect()
    assert sorted((r.project, r.commit_index) for r in got) == [("proj", 1), ("proj", 2)]
    rows, conflicts = files.merge_results([files.read_ledger(spark, str(tmp_path)), files.read_ledger(spark, str(tmp_path)).limit(1)])
    assert rows.count() == 4 and {r.conflict for r in conflicts.collect()} == {"repeated"}
    files.append_ledger(rows.withColumn("timestamp", F.lit(None).cast("string")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("timestamp IS NOT NULL").count() == 4
    files.write_report({"t": rows}, str(tmp_path / "report"))
    assert files.read_csv(spark, str(tmp_path / "report/t")).count() == 4


def test_manifest_and_push_events(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"$about": 1, "projects": [{"name": "a", "source": "s"}, {"name": "b", "commits": 7, "start": "abc", "branch": "dev", "$note": "x"}]}))
    (tmp_path / "list.json").write_text(json.dumps([{"name": "c", "source": "s", "provenance": "found"}]))
    got = files.read_manifest(spark, str(tmp_path / "c.json")).collect()
    assert [(r.name, r.commits, r.branch, r.start, r.provenance, r.uml, r.notes) for r in got] == [("a", 30, None, None, "", None, ""), ("b", 7, "dev", "abc", "", None, "")]
    assert [(r.name, r.commits, r.provenance) for r in files.read_manifest(spark, str(tmp_path / "list.json")).collect()] == [("c", 30, "found")]
    kind = "event string, project string, commits array<struct<added:array<string>,modified:array<string>,removed:array<string>>>"
    events = spark.createDataFrame([("push", "p", [(["a"], ["b"], []), (["a"], [], ["c"])]), ("ping", "p", [(["z"], [], [])])], kind)
    assert sorted(r.path for r in files.changed_files(events).collect()) == ["a", "b", "c"]


def test_streaming_gate_equals_batch(spark, tmp_path):
    snaps = [("p", v, f"t{v // 2}", f"s{v // 3}", f"d{v // 5}") for v in range(9)] + [("q", v, "t", "s", "d") for v in range(3)]
    kind = "project string, version long, text_hash string, structure_hash string, design_hash string"
    batch = spark.createDataFrame(snaps, kind)
    (tmp_path / "in").mkdir()
    batch.where("version < 4").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = jobs.stream_gate(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    writer = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True)
    writer.start().awaitTermination()
    batch.where("version >= 4").unionByName(batch.where("version = 1")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    writer.start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = gate.decide(batch, ("always", "content", "structural")).select("project", "version", "gate_strategy", "fired")
    assert got.where("late").count() == 2
    assert got.where("NOT late").drop("late").exceptAll(want).count() == 0 and want.count() == got.where("NOT late").count()


def test_streaming_metrics_and_diff(spark, tmp_path):
    kind = "project string, gate_strategy string, gate_allowed_llm boolean, prompt_tokens long, completion_tokens long"
    runs = spark.createDataFrame([("p", "g", True, 5, 1), ("p", "g", False, 0, 0)], kind)
    runs.write.parquet(str(tmp_path / "runs"))
    query = jobs.stream_metrics(spark.readStream.schema(kind).parquet(str(tmp_path / "runs"))).writeStream.format("memory").queryName("ledger").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("ledger").collect()] == [("p", "g", 2, 1, 6)]
    nodes = spark.createDataFrame([("p", v, n, "class", "1") for v, ns in ((1, "AB"), (2, "AC")) for n in ns], "project string, version long, node string, kind string, signature string")
    edges = spark.createDataFrame([("p", 1, "A", "B", "calls"), ("p", 2, "A", "C", "calls")], "project string, version long, src string, dst string, relation string")
    files.write_snapshot(nodes, edges, str(tmp_path / "snap"))
