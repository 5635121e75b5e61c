"""Sources and sinks: source snapshots, facts, design documents, ledgers, manifests, push events, reports."""

from __future__ import annotations

import ast
import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import language

#: Folders that hold no project code, and the size beyond which a file is skipped.
SKIPPED = ("node_modules", "venv", "__pycache__", "dist", "build", "target", "vendor", "site-packages", "coverage", "bin", "obj")
MOST_BYTES = 2 * 1024 * 1024

_CALL = "struct<name:string,receiver:string,instantiation:boolean>"
_CALLABLE = f"struct<name:string,owner:string,params:bigint,param_types:array<string>,param_names:array<string>,returns:string,calls:array<string>,call_refs:array<{_CALL}>,local_types:map<string,string>>"
FACTS = (
    "project string, version bigint, file_path string, language string, loc bigint, text_sha256 string, parse_error boolean, imports array<string>, "
    "import_bindings array<struct<module:string,symbol:string,alias:string>>, "
    f"classes array<struct<name:string,kind:string,bases:array<string>,fields:array<struct<name:string,type:string>>,methods:array<{_CALLABLE}>>>, functions array<{_CALLABLE}>"
)
RUNS = (
    "project string, provenance string, gate_strategy string, commit_index bigint, commit string, gate_allowed_llm boolean, llm_invoked boolean, "
    "prompt_tokens bigint, completion_tokens bigint, latency_ms double, missed_change boolean, conformance_changed boolean, findings_hash string, timestamp string"
)


def scan_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, modified, length, language, content of known source files under a tree; vendor and hidden folders and large files are left out.

    Length and path filters are applied by the reader before it opens a file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= MOST_BYTES)
    inside = ~F.col("path").rlike(rf"/(?:{'|'.join(SKIPPED)}|\.[^/]+)/")
    return files.where(inside).select("path", F.col("modificationTime").alias("modified"), "length", language(F.col("path")).alias("language"), "content").where("language IS NOT NULL")


def unsupported_extensions(spark: SparkSession, path: str, known: tuple[str, ...] = ("go", "rb", "rs", "kt", "swift", "cpp", "c")) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    return files.select(ext.alias("extension")).where(F.col("extension").isin(*known)).distinct()


def file_inventory(spark: SparkSession, path: str, most: int = 5000) -> DataFrame:
    """``tree`` of the files under a path, from metadata columns only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"))
    inside = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "^" + "/" + path.lstrip("/").rstrip("/") + "/", "")
    return tree(files.select(F.lit(0).alias("project"), inside.alias("path"), "size"), "project", most=most).drop("project")


def tree(files: DataFrame, *keys: str, most: int = 5000) -> DataFrame:
    """(keys, path, type, size, files, place) of files(keys, path, size) and of the folders they lie in.

    Every file adds to all folders above it, with partial sums before the shuffle. Order: depth, folders before files,
    path; at most ``most`` entries a key.
    """
    one = files.groupBy(*keys, "path").agg(F.max("size").alias("size"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = one.where(F.contains("path", F.lit("/"))).select(*keys, F.explode(above).alias("path"), "size").where("path <> ''")
    folders = folders.groupBy(*keys, "path").agg(F.lit("tree").alias("type"), F.sum("size").alias("size"), F.count("*").alias("files"))
    both = one.select(*keys, "path", F.lit("blob").alias("type"), F.col("size").cast("bigint").alias("size"), F.lit(1).cast("bigint").alias("files")).unionByName(folders)
    order = (F.size(F.split("path", "/")), F.col("type") == "blob", F.col("path"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    return both.withColumn("place", place).where(F.col("place") <= most)


def totals(files: DataFrame, *keys: str) -> DataFrame:
    """(keys, files, directories, bytes)."""
    whole = tree(files, *keys, most=2**31 - 1)
    blob = F.col("type") == "blob"
    return whole.groupBy(*keys).agg(F.count_if(blob).alias("files"), F.count_if(~blob).alias("directories"), F.sum(F.when(blob, F.col("size")).otherwise(0)).cast("bigint").alias("bytes"))


def overview(versions: DataFrame, files: DataFrame, designs: DataFrame, *keys: str) -> DataFrame:
    """One row per key: versions kept, the latest with its score and time, files, and whether there is a design.

    versions(keys, version, score, created_at), files(keys, path, size), designs(keys, path).
    """
    latest = F.max_by(F.struct("score", "created_at"), "version")
    kept = versions.groupBy(*keys).agg(F.count("*").alias("versions"), F.max("version").alias("latest_version"), latest.alias("latest"))
    out = kept.join(totals(files, *keys), list(keys), "full_outer").join(designs.select(*keys).distinct().withColumn("has_design", F.lit(True)), list(keys), "left")
    return out.select(
        *keys, F.coalesce("versions", F.lit(0)).cast("bigint").alias("versions"), "latest_version", F.col("latest.score").alias("latest_score"), F.col("latest.created_at").alias("last_analysed"),
        *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files", "directories", "bytes")), F.coalesce("has_design", F.lit(False)).alias("has_design"),
    )


def _own(node: ast.AST) -> Iterator[ast.AST]:
    """The nodes of a declaration in source order, without those of declarations inside it."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child
            yield from _own(child)


def _callable_facts(node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> dict:
    args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    args = args[1:] if owner and args and args[0].arg in ("self", "cls") else args
    refs, local = [], {}
    for x in _own(node):
        if isinstance(x, ast.Call):
            said = ast.unparse(x.func)
            receiver, _, name = said.rpartition(".")
            if name.isidentifier() and len(said) <= 200:
                refs.append({"name": name, "receiver": receiver or None, "instantiation": name[:1].isupper()})
        elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and isinstance(x.targets[0], ast.Name) and isinstance(x.value.func, ast.Name):
            if x.value.func.id[:1].isupper():
                local.setdefault(x.targets[0].id, x.value.func.id)
        elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            said = ast.unparse(x.annotation)
            if said[:1].isupper():
                local.setdefault(x.target.id, said)
    return {
        "name": node.name,
        "owner": owner,
        "params": len(args),
        "param_types": [ast.unparse(a.annotation) if a.annotation else "Object" for a in args],
        "param_names": [a.arg for a in args],
        "returns": ast.unparse(node.returns) if node.returns else "void",
        "calls": sorted({r["name"] for r in refs[:96]}),
        "call_refs": refs[:96],
        "local_types": local,
    }


def _class_facts(node: ast.ClassDef) -> dict:
    fields: dict[str, str | None] = {}
    methods = [x for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))]
    for x in node.body:
        if isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name):
            fields[x.target.id] = ast.unparse(x.annotation)
    for m in methods:
        types = {a.arg: ast.unparse(a.annotation) for a in m.args.args if a.annotation}
        for x in ast.walk(m):
            target = x.targets[0] if isinstance(x, ast.Assign) else x.target if isinstance(x, ast.AnnAssign) else None
            if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                kind = ast.unparse(x.annotation) if isinstance(x, ast.AnnAssign) else None
                if kind is None and isinstance(x.value, ast.Name):
                    kind = types.get(x.value.id)
                if kind is None and isinstance(x.value, ast.Call) and isinstance(x.value.func, ast.Name) and x.value.func.id[:1].isupper():
                    kind = x.value.func.id
                fields[target.attr] = fields.get(target.attr) or kind
    bases = [ast.unparse(b) for b in node.bases]
    kind = "interface" if {"ABC", "Protocol"} & {b.rpartition(".")[2] for b in bases} else "enum" if any(b.endswith("Enum") for b in bases) else "class"
    return {"name": node.name, "kind": kind, "bases": sorted(set(bases)), "fields": [{"name": k, "type": v} for k, v in fields.items()], "methods": [_callable_facts(m, node.name) for m in methods]}


def python_facts(path: str, content: bytes) -> dict:
    """Facts of one Python file; a file that cannot be parsed is a row with parse_error, not a missing one."""
    out = {"file_path": path, "language": "python", "loc": content.count(b"\n") + 1, "text_sha256": hashlib.sha256(content).hexdigest(), "parse_error": False, "imports": [], "import_bindings": [], "classes": [], "functions": []}
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return out | {"parse_error": True}
    for x in ast.walk(tree):
        if isinstance(x, ast.Import):
            out["import_bindings"] += [{"module": a.name, "symbol": None, "alias": a.asname} for a in x.names]
        elif isinstance(x, ast.ImportFrom):
            out["import_bindings"] += [{"module": "." * x.level + (x.module or ""), "symbol": a.name, "alias": a.asname} for a in x.names]
    out["imports"] = sorted({b["module"] for b in out["import_bindings"]})
    out["classes"] = sorted((_class_facts(x) for x in ast.walk(tree) if isinstance(x, ast.ClassDef)), key=lambda c: c["name"])
    out["functions"] = sorted((_callable_facts(x, None) for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))), key=lambda f: f["name"])
    return out


def extract_facts(files: DataFrame, extract: Callable[[str, bytes], dict] = python_facts) -> DataFrame:
    """Fact records of files(project, version, file_path, content), in parallel over all snapshots; ``extract`` may be the caller's own."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{"project": p, "version": v} | extract(f, bytes(c)) for p, v, f, c in zip(frame.project, frame.version, frame.file_path, frame.content, strict=True)]
            yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _top_level(FACTS)])

    return files.select("project", "version", "file_path", "content").mapInPandas(run, FACTS)


def _top_level(schema: str) -> list[str]:
    out, depth, word = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return [*out, word.strip()]


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FACTS).json(path)


def structure_hash(facts: DataFrame) -> DataFrame:
    """facts plus structure_hash: imports, classes and functions in name order; no receivers, locals, literals, comments or order of methods."""

    def shape(m: Column) -> Column:
        return F.struct(m["name"], m["params"], m["param_types"], m["returns"], F.array_sort(F.array_distinct(m["calls"])).alias("calls"))

    def methods(of: Column) -> Column:
        return F.array_sort(F.transform(of, shape))

    classes = F.array_sort(
        F.transform("classes", lambda c: F.struct(c["name"], c["kind"], F.array_sort(F.array_distinct(c["bases"])).alias("bases"), F.array_sort(c["fields"]).alias("fields"), methods(c["methods"]).alias("methods")))
    )
    view = F.struct(F.array_sort(F.array_distinct("imports")).alias("imports"), classes.alias("classes"), methods(F.col("functions")).alias("functions"))
    return facts.withColumn("structure_hash", F.sha2(F.to_json(view), 256))


def read_designs(spark: SparkSession, path: str) -> DataFrame:
    """path, document (VARIANT) and status of every design file: ok or malformed; a bad file stays a row."""
    raw = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    document = F.try_parse_json("value")
    return raw.select("path", document.alias("document"), F.when(document.isNull(), "malformed").otherwise("ok").alias("status"), F.sha2("value", 256).alias("design_hash"))


def active_designs(designs: DataFrame, *keys: str) -> DataFrame:
    """The alphabetically first design file per project."""
    name = F.substring_index("path", "/", -1)
    return designs.groupBy(*keys).agg(F.min_by("path", name).alias("path"))


NODES = "node_id string, parent_id string, type string, name string, attributes string"


def flatten_designs(documents: DataFrame) -> DataFrame:
    """doc, node_id, parent_id, type, name, pos, raw: every JSON object with ``_type`` and ``_id`` of documents(doc, text), at any depth."""

    def walk(value, parent, out):
        if isinstance(value, dict):
            here = parent
            if "_type" in value and "_id" in value:
                plain = {k: v for k, v in value.items() if not (isinstance(v, (list, dict)) and k != "$ref" and not (isinstance(v, dict) and "$ref" in v))}
                out.append((value["_id"], parent, value["_type"], value.get("name"), json.dumps(plain)))
                here = value["_id"]
            for k, v in value.items():
                if isinstance(v, dict) and k in ("end1", "end2") and "reference" in v and "_id" not in v:
                    continue
                walk(v, here, out)
        elif isinstance(value, list):
            for v in value:
                walk(v, parent, out)

    def run(frames):
        for frame in frames:
            rows = []
            for doc, text in zip(frame.doc, frame.text, strict=True):
                try:
                    parsed = json.loads(text)
                except (ValueError, TypeError):
                    continue
                out: list[tuple] = []
                walk(parsed, None, out)
                ends = {}
                _ends(parsed, ends)
                rows += [(doc, i, n, p, t, name, raw, *ends.get(n, (None, None))) for i, (n, p, t, name, raw) in enumerate(out)]
            yield pd.DataFrame(rows, columns=["doc", "pos", "node_id", "parent_id", "type", "name", "raw", "end1", "end2"])

    def _ends(value, found):
        if isinstance(value, dict):
            if "_id" in value and isinstance(value.get("end1"), dict):
                found[value["_id"]] = tuple((value.get(e) or {}).get("reference", {}).get("$ref") for e in ("end1", "end2"))
            for v in value.values():
                _ends(v, found)
        elif isinstance(value, list):
            for v in value:
                _ends(v, found)

    return documents.select("doc", "text").mapInPandas(run, "doc string, pos bigint, node_id string, parent_id string, type string, name string, raw string, end1 string, end2 string")


#: Design node types and the relation each stands for.
RELATIONS = {"UMLGeneralization": "generalization", "UMLRealization": "realization", "UMLInterfaceRealization": "realization", "UMLAssociation": "association", "UMLDependency": "dependency"}
ELEMENTS = {"UMLClass": "class", "UMLInterface": "interface"}


def design_elements(nodes: DataFrame) -> DataFrame:
    """(doc, element, element_type, node_id): named classes and interfaces, the first of a name."""
    kinds = F.create_map(*(F.lit(x) for kv in ELEMENTS.items() for x in kv))
    named = nodes.where(F.col("type").isin(*ELEMENTS) & (F.trim("name") != "")).withColumn("element_type", F.try_element_at(kinds, F.col("type")))
    return named.groupBy("doc", F.col("name").alias("element")).agg(F.min_by("element_type", "pos").alias("element_type"), F.min_by("node_id", "pos").alias("node_id"))


def design_members(nodes: DataFrame) -> DataFrame:
    """(doc, element, member, member_kind, type, visibility): attributes with their type, operations with their return type (void without one)."""
    owner = nodes.where(F.col("type").isin(*ELEMENTS)).select("doc", F.col("node_id").alias("parent_id"), F.col("name").alias("element"))
    names = nodes.select("doc", F.col("node_id").alias("ref"), F.col("name").alias("ref_name"))
    json_ = lambda p: F.get_json_object("raw", p)
    typed = nodes.withColumns({"ref": json_("$.type['$ref']"), "said": json_("$.type")}).join(names, ["doc", "ref"], "left")
    kind = F.when(F.col("ref").isNotNull(), F.col("ref_name")).otherwise(F.col("said"))
    back = typed.where("type = 'UMLParameter'").where(json_("$.direction") == "return").select("doc", F.col("parent_id").alias("node_id"), kind.alias("returned"))
    mine = typed.where(F.col("type").isin("UMLAttribute", "UMLOperation")).join(owner, ["doc", "parent_id"]).join(back, ["doc", "node_id"], "left")
    attribute = F.col("type") == "UMLAttribute"
    return mine.select(
        "doc", "element", F.col("name").alias("member"), F.when(attribute, "attribute").otherwise("method").alias("member_kind"),
        F.when(attribute, F.coalesce(kind, F.lit("Object"))).otherwise(F.coalesce("returned", F.lit("void"))).alias("type"), F.coalesce(json_("$.visibility"), F.lit("public")).alias("visibility"),
    )


def design_relations(nodes: DataFrame) -> DataFrame:
    """(doc, source, target, relation): by source and target references, or by the ends of an association; unresolved ones are dropped."""
    kinds = F.create_map(*(F.lit(x) for kv in RELATIONS.items() for x in kv))
    source = F.coalesce(F.get_json_object("raw", "$.source['$ref']"), "end1")
    target = F.coalesce(F.get_json_object("raw", "$.target['$ref']"), "end2")
    rel = nodes.where(F.col("type").isin(*RELATIONS)).select("doc", "pos", source.alias("s"), target.alias("t"), F.try_element_at(kinds, F.col("type")).alias("relation"))
    name = nodes.select("doc", "node_id", "name")
    out = rel.join(name.withColumnsRenamed({"node_id": "s", "name": "source"}), ["doc", "s"]).join(name.withColumnsRenamed({"node_id": "t", "name": "target"}), ["doc", "t"])
    return out.where("source IS NOT NULL AND target IS NOT NULL").select("doc", "source", "target", "relation", "pos")


def fold_relations(elements: DataFrame, relations: DataFrame) -> DataFrame:
    """Elements with ``extends``, the target of their first generalization, and ``implements``, the distinct targets of their realizations in order."""
    first = relations.where("relation = 'generalization'").groupBy("doc", F.col("source").alias("element")).agg(F.min_by("target", "pos").alias("extends"))
    each = relations.where("relation = 'realization'").groupBy("doc", F.col("source").alias("element"), "target").agg(F.min("pos").alias("pos"))
    listed = each.groupBy("doc", "element").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "target"))), lambda x: x["target"]).alias("implements"))
    out = elements.join(first, ["doc", "element"], "left").join(listed, ["doc", "element"], "left")
    return out.withColumn("implements", F.coalesce("implements", F.array().cast("array<string>")))


def design_warnings(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, warning, name) of documents(doc, text): malformed, no elements, and elements left out as unnamed or as a name's second."""
    kinds = nodes.where(F.col("type").isin(*ELEMENTS)).withColumn("blank", F.trim(F.coalesce("name", F.lit(""))) == "")
    none = F.lit(None).cast("string").alias("name")
    bad = documents.where(F.try_parse_json("text").isNull()).select("doc", F.lit("malformed").alias("warning"), none)
    fine = documents.where(F.try_parse_json("text").isNotNull()).select("doc")
    empty = fine.join(kinds.where("NOT blank"), "doc", "left_anti").select("doc", F.lit("no elements").alias("warning"), none)
    unnamed = kinds.where("blank").select("doc", F.lit("unnamed element").alias("warning"), none)
    place = F.row_number().over(Window.partitionBy("doc", "name").orderBy("pos"))
    twice = kinds.where("NOT blank").withColumn("k", place).where("k > 1").select("doc", F.lit("repeated name").alias("warning"), "name")
    return bad.unionByName(empty).unionByName(unnamed).unionByName(twice)


def design_status(projects: DataFrame, designs: DataFrame) -> DataFrame:
    """(project, status, design_hash) of every project: its active design's hash, or the words none and error where there is none or it cannot be read."""
    name = F.substring_index("path", "/", -1)
    first = designs.groupBy("project").agg(F.min_by(F.struct("status", "design_hash"), name).alias("d"))
    status = F.when(F.col("d").isNull(), "none").when(F.col("d.status") == "ok", "ok").otherwise("error")
    out = projects.select("project").distinct().join(first, "project", "left").withColumn("status", status)
    return out.select("project", "status", F.when(F.col("status") == "ok", F.col("d.design_hash")).otherwise(F.col("status")).alias("design_hash"))


def screen_designs(documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc, elements, members, relations, unsuitable) of every document: one without a named element is unsuitable for a study."""
    counts = [t.groupBy("doc").agg(F.count("*").alias(n)) for t, n in ((design_elements(nodes), "elements"), (design_members(nodes), "members"), (design_relations(nodes), "relations"))]
    out = documents.select("doc").distinct()
    for table in counts:
        out = out.join(table, "doc", "left")
    out = out.fillna(0)
    return out.withColumn("unsuitable", F.col("elements") == 0)


def read_ledger(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Run rows from JSON lines: broken lines are skipped, the project comes from the path where a row has none, the newest N per project."""
    rows = spark.read.schema(RUNS).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    rows = rows.withColumn("project", F.coalesce("project", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1)))
    if newest is None:
        return rows
    place = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("timestamp"), F.desc("commit_index")))
    return rows.withColumn("place", place).where(F.col("place") <= newest).drop("place")


def append_ledger(rows: DataFrame, path: str) -> None:
    stamped = rows.withColumn("timestamp", F.coalesce("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")))
    stamped.write.mode("append").partitionBy("project").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Projects of a corpus manifest, an object with ``projects`` or a list of them, with defaults; other keys, such as comments that begin with $, are ignored."""
    kinds = {c: "string" for c in ("name", "source", "uml", "branch", "subdirectory", "notes", "start", "provenance")} | {"commits": "bigint"}
    project = f"struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>"
    text = spark.read.text(path, wholetext=True).select(F.col("value"))
    listed = F.startswith(F.ltrim("value", F.lit(" \t\r\n")), F.lit("["))
    given = F.when(listed, F.from_json("value", f"array<{project}>")).otherwise(F.from_json("value", f"projects array<{project}>")["projects"])
    out = text.select(F.inline(given)).where("name IS NOT NULL")
    return out.withColumns({"commits": F.coalesce("commits", F.lit(30)), "notes": F.coalesce("notes", F.lit("")), "provenance": F.coalesce("provenance", F.lit(""))})


def merge_results(parts: list[DataFrame], oracle: tuple[str, ...] = ("conformance_changed",)) -> tuple[DataFrame, DataFrame]:
    """All rows of partial results under the union of their columns, and the conflicts: repeated keys and oracle columns that disagree."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    twice = rows.groupBy("project", "gate_strategy", "commit_index").count().where("count > 1").select("project", "commit_index", F.lit("repeated").alias("conflict"))
    differ = rows.groupBy("project", "commit_index").agg(F.countDistinct(F.struct(*oracle)).alias("n")).where("n > 1").select("project", "commit_index", F.lit("oracle").alias("conflict"))
    return rows, twice.unionByName(differ)


def merge_elements(parts: list[DataFrame]) -> DataFrame:
    """Element rows of partial results, one per project, commit and element: the one of the first part that has it, its least row there."""
    rows = parts[0].withColumn("part", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("part", F.lit(i)), allowMissingColumns=True)
    keys = ("project", "commit_index", "element")
    others = [c for c in rows.columns if c not in (*keys, "part")]
    return rows.groupBy(*keys).agg(F.min(F.struct("part", *others)).alias("row")).select(*keys, *(F.col("row")[c].alias(c) for c in others))


def changed_files(events: DataFrame) -> DataFrame:
    """(project, path) that push events (event, project, commits[added, modified, removed]) touch, distinct; other events are ignored."""
    each = events.where("event = 'push'").select("project", F.explode("commits").alias("c"))
    paths = F.array_union(F.array_union("c.added", "c.modified"), "c.removed")
    return each.select("project", F.explode(paths).alias("path")).distinct()


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables of snapshots, partitioned so that a version is a folder."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.write.mode("append").partitionBy("project", "version").parquet(f"{path}/{name}")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
