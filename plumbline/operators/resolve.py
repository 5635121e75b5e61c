"""Symbol resolution: call sites to definitions by left joins to unique symbol tables, then one cascade.

Tables are keyed by ``keys`` (project, version). A name that several definitions share is counted and
never joined to all of them, so a common method name cannot blow up the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The buckets a call site may fall into.
BUCKETS = ("instantiation", "self", "field", "local", "static", "import", "same_file", "unique_global", "ambiguous", "external")


def unique(table: DataFrame, name: str, value: str, *keys: str) -> DataFrame:
    """(keys, name, value, candidates): value only where a single candidate has the name."""
    out = table.select(*keys, name, value).distinct().groupBy(*keys, name).agg(F.count("*").alias("candidates"), F.min(value).alias("only"))
    return out.select(*keys, name, F.when(F.col("candidates") == 1, F.col("only")).alias(value), "candidates")


def ancestors(bases: DataFrame, *keys: str, depth: int = 4) -> DataFrame:
    """(keys, class, ancestor, path): a class, then its bases (class, base, pos) depth first, to ``depth`` levels; cycles end there."""
    now = bases.select(*keys, F.col("class")).unionByName(bases.select(*keys, F.col("base").alias("class"))).distinct()
    now = now.select(*keys, "class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("path"))
    out = now
    step = bases.select(*keys, F.col("class").alias("ancestor"), F.col("base").alias("next"), F.col("pos").cast("int").alias("pos"))
    for _ in range(depth):
        now = now.join(step, [*keys, "ancestor"]).select(*keys, "class", F.col("next").alias("ancestor"), F.concat("path", F.array("pos")).alias("path"))
        out = out.unionByName(now)
    return out


def inherited_methods(methods: DataFrame, bases: DataFrame, *keys: str, depth: int = 4) -> DataFrame:
    """(keys, class, name, method_id): the own method, else the first one found in the bases, depth first."""
    classes = methods.select(*keys, "class").distinct()
    line = ancestors(bases, *keys, depth=depth)
    line = line.unionByName(classes.join(line.select(*keys, "class").distinct(), [*keys, "class"], "left_anti").select(*keys, "class", F.col("class").alias("ancestor"), F.array().cast("array<int>").alias("path")))
    own = methods.groupBy(*keys, F.col("class").alias("ancestor"), "name").agg(F.min_by("method_id", "pos").alias("method_id"))
    return line.join(own, [*keys, "ancestor"]).groupBy(*keys, "class", "name").agg(F.min_by("method_id", "path").alias("method_id"))


def import_targets(bindings: DataFrame, modules: DataFrame, *keys: str) -> DataFrame:
    """(keys, file, symbol, target): the first binding (file, pos, module, symbol, alias) of a symbol whose module key is unique."""
    known = unique(modules, "module", "target", *keys).where("target IS NOT NULL").select(*keys, "module", "target")
    leaf = F.element_at(F.split("module", r"[./]"), -1)
    named = bindings.withColumn("as", F.coalesce("alias", "symbol", leaf))
    return named.join(known, [*keys, "module"]).groupBy(*keys, "file", F.col("as").alias("symbol")).agg(F.min_by("target", "pos").alias("target"))


def resolve_by_name(sites: DataFrame, definitions: DataFrame, *keys: str) -> DataFrame:
    """sites(.., caller_file, callee) with target and bucket from definitions(def_id, def_file, name): same_file, unique_global, ambiguous or external."""
    here = definitions.groupBy(*keys, F.col("name").alias("callee"), F.col("def_file").alias("caller_file")).agg(F.min("def_id").alias("local_id"))
    everywhere = unique(definitions.withColumnRenamed("name", "callee"), "callee", "def_id", *keys)
    out = sites.join(here, [*keys, "callee", "caller_file"], "left").join(everywhere, [*keys, "callee"], "left")
    bucket = F.when(F.col("local_id").isNotNull(), "same_file").when(F.col("def_id").isNotNull(), "unique_global").when(F.col("candidates") > 1, "ambiguous").otherwise("external")
    return out.withColumn("bucket", bucket).withColumn("target", F.when(F.col("bucket") == "same_file", F.col("local_id")).when(F.col("bucket") == "unique_global", F.col("def_id"))).drop("local_id", "def_id", "candidates")


def resolve_calls(
    sites: DataFrame, classes: DataFrame, methods: DataFrame, fields: DataFrame, bases: DataFrame, functions: DataFrame, imports: DataFrame, *keys: str
) -> DataFrame:
    """(keys, site, bucket, target) by the whole cascade for sites(site, file, class, receiver, name, instantiation, local_type).

    classes(class, file[, class_name]) where class identifies a class and class_name, if it is not the same, is what code
    calls it; methods(class, name, method_id, pos), fields(class, field, type), bases(class, base, pos) with types and bases
    by name, functions(file, name, function_id), imports(file, symbol, target). A type or base counts where one class has the
    last part of its name. A receiver that is known but lacks the method is external and does not fall through to looser rules;
    a bare call tries the own class, the file, the imports, then what is unique in the whole project.
    """
    if "class_name" not in classes.columns:
        classes = classes.withColumn("class_name", F.col("class"))
    known = unique(classes, "class_name", "class", *keys).where("class IS NOT NULL").select(*keys, "class_name", "class")
    last_part = lambda c: F.substring_index(c, ".", -1)

    def find_class(rows: DataFrame, called: Column | str, found: str) -> DataFrame:
        names = known.withColumnsRenamed({"class_name": "_called", "class": found})
        return rows.withColumn("_called", last_part(called)).join(names, [*keys, "_called"], "left").drop("_called")

    parents = find_class(bases, "base", "parent").where("parent IS NOT NULL AND parent <> class").select(*keys, "class", F.col("parent").alias("base"), "pos")
    of = inherited_methods(methods, parents, *keys).select(*keys, F.col("class").alias("holder"), "name", "method_id")
    typed = find_class(fields, "type", "field_class").select(*keys, "class", F.col("field").alias("member"), "field_class")
    local = functions.groupBy(*keys, "file", "name").agg(F.min("function_id").alias("local_function"))
    placed = classes.groupBy(*keys, "file", F.col("class_name").alias("name")).agg(F.min("class").alias("file_class"))
    anywhere = functions.select(*keys, "name", F.col("function_id").alias("id")).unionByName(methods.select(*keys, "name", F.col("method_id").alias("id")))

    head = F.substring_index("receiver", ".", 1)
    rest = F.when(F.contains("receiver", F.lit(".")), F.expr("substring(receiver, instr(receiver, '.') + 1)"))
    rows = sites.withColumns({"head": head, "member": F.substring_index(rest, ".", 1), "symbol": F.coalesce(head, "name")})
    rows = rows.join(typed, [*keys, "class", "member"], "left")
    rows = find_class(find_class(find_class(rows, "local_type", "local_class"), "head", "static_class"), "name", "made_class")
    made, bare, own = F.col("instantiation"), F.col("receiver").isNull(), F.col("head").isin("self", "this")
    holder = F.when(made, None).when(bare | (own & F.col("member").isNull()), F.col("class")).when(own, F.col("field_class")).otherwise(F.coalesce("local_class", "static_class"))
    rows = rows.withColumn("holder", holder).join(of, [*keys, "holder", "name"], "left")
    rows = rows.join(imports.select(*keys, "file", "symbol", F.col("target").alias("import_file")), [*keys, "file", "symbol"], "left")
    rows = rows.join(local, [*keys, "file", "name"], "left").join(placed, [*keys, "file", "name"], "left")
    rows = rows.join(local.withColumnsRenamed({"file": "import_file", "local_function": "imported_function"}), [*keys, "import_file", "name"], "left")
    rows = rows.join(placed.withColumnsRenamed({"file": "import_file", "file_class": "imported_class"}), [*keys, "import_file", "name"], "left")
    rows = rows.join(unique(anywhere, "name", "id", *keys), [*keys, "name"], "left")

    has = lambda c: F.col(c).isNotNull()
    pick = lambda bucket, c: F.struct(F.lit(bucket).alias("bucket"), (F.lit(None).cast("string") if c is None else F.col(c).cast("string")).alias("target"))
    through = F.when(own & F.col("member").isNull(), pick("self", "method_id")).when(own, pick("field", "method_id")).when(has("local_class"), pick("local", "method_id")).otherwise(pick("static", "method_id"))
    verdict = (
        F.when(made, F.when(has("made_class"), pick("instantiation", "made_class")).otherwise(pick("external", None)))
        .when(~bare & has("method_id"), through)
        .when(~bare & (own | has("holder")), pick("external", None))
        .when(~bare & has("imported_function"), pick("import", "imported_function"))
        .when(~bare & has("imported_class"), pick("import", "imported_class"))
        .when(~bare, pick("external", None))
        .when(has("method_id"), pick("self", "method_id"))
        .when(has("local_function"), pick("same_file", "local_function"))
        .when(has("file_class"), pick("instantiation", "file_class"))
        .when(has("imported_function"), pick("import", "imported_function"))
        .when(has("imported_class"), pick("instantiation", "imported_class"))
        .when(has("id"), pick("unique_global", "id"))
        .when(F.col("candidates") > 1, pick("ambiguous", None))
        .when(has("made_class"), pick("instantiation", "made_class"))
        .otherwise(pick("external", None))
    )
    return rows.select(*keys, "site", verdict.alias("v")).select(*keys, "site", "v.bucket", "v.target")


def call_edges(resolved: DataFrame, nodes: DataFrame, *keys: str) -> DataFrame:
    """Distinct (src, dst, relation) from resolved sites (caller, target, bucket), without loops and unknown targets."""
    known = nodes.select(*keys, F.col("node").alias("dst")).distinct()
    relation = F.when(F.col("bucket") == "instantiation", "instantiates").otherwise("calls")
    out = resolved.where("target IS NOT NULL AND target <> caller").select(*keys, F.col("caller").alias("src"), F.col("target").alias("dst"), relation.alias("relation"))
    return out.join(known, [*keys, "dst"], "left_semi").distinct()


def resolution_stats(resolved: DataFrame, *keys: str) -> DataFrame:
    """Sites per bucket, how many are resolved, and the rate; NULL without sites."""
    counts = [F.sum((F.col("bucket") == b).cast("bigint")).alias(b) for b in BUCKETS]
    hit = F.sum((~F.col("bucket").isin("ambiguous", "external")).cast("bigint"))
    out = resolved.groupBy(*keys).agg(*counts, F.count("*").alias("sites"), hit.alias("resolved"))
    return out.withColumn("rate", F.try_divide(F.col("resolved").cast("double"), F.col("sites").cast("double")))


def split_supertypes(bases: DataFrame, interfaces: DataFrame, *keys: str) -> DataFrame:
    """Per class (class, is_interface, base, base_kind, pos): extends (first parent), implements, untyped_supertypes."""
    known = interfaces.select(*keys, F.col("name").alias("base")).distinct().withColumn("project_interface", F.lit(True))
    rows = bases.join(known, [*keys, "base"], "left")
    implements = ~F.col("is_interface") & ((F.col("base_kind") == "implements") | ((F.coalesce("base_kind", F.lit("unknown")) == "unknown") & F.col("project_interface").isNotNull()))
    rows = rows.withColumn("implements", implements)
    out = rows.groupBy(*keys, "class").agg(
        F.min_by("base", F.when(~F.col("implements"), F.col("pos"))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("implements"), F.struct("pos", "base")))).alias("i"),
        F.array_sort(F.collect_list(F.when(~F.col("implements"), F.struct("pos", "base")))).alias("e"),
    )
    names = {c: F.transform(c, lambda x: x["base"]) for c in ("i", "e")}
    return out.select(*keys, "class", F.when(F.size("e") > 0, F.get(names["e"], F.lit(0))).alias("extends"), names["i"].alias("implements"), F.slice(names["e"], 2, F.greatest(F.size("e"), F.lit(1))).alias("untyped_supertypes"))


def implementation_graph(
    modules: DataFrame, classes: DataFrame, methods: DataFrame, supertypes: DataFrame, calls: DataFrame, *keys: str, functions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the code: modules contain classes and functions, classes methods; inheritance; resolved calls.

    One edge per ordered pair, the last kind wins: contains, inheritance, calls. Only nodes that exist have edges, and none to itself.
    """
    nodes = modules.select(*keys, F.col("file").alias("node"), F.lit("module").alias("kind"))
    nodes = nodes.unionByName(classes.select(*keys, F.col("class").alias("node"), "kind")).unionByName(methods.select(*keys, F.col("method_id").alias("node"), F.lit("method").alias("kind")))
    edge = lambda t, src, dst, relation, ord: t.select(*keys, F.col(src).alias("src"), F.col(dst).alias("dst"), relation.alias("relation"), F.lit(ord).alias("ord"))
    edges = edge(classes, "file", "class", F.lit("contains"), 1).unionByName(edge(methods, "class", "method_id", F.lit("contains"), 1))
    if functions is not None:
        nodes = nodes.unionByName(functions.select(*keys, F.col("function_id").alias("node"), F.lit("function").alias("kind")))
        edges = edges.unionByName(edge(functions, "file", "function_id", F.lit("contains"), 1))
    edges = edges.unionByName(edge(supertypes, "class", "base", F.col("relation"), 3)).unionByName(edge(calls, "src", "dst", F.col("relation"), 4))
    one = edges.where("src <> dst").groupBy(*keys, "src", "dst").agg(F.max_by("relation", F.struct("ord", "relation")).alias("relation"))
    nodes = nodes.distinct()
    for end in ("src", "dst"):
        one = one.join(nodes.select(*keys, F.col("node").alias(end)).distinct(), [*keys, end], "left_semi")
    return nodes, one.select(*keys, "src", "dst", "relation")


def design_graph(elements: DataFrame, relations: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a design; elements that are referred to but not declared become uml-implied classes."""
    edges = relations.select(*keys, F.col("source").alias("src"), F.col("target").alias("dst"), "relation").distinct()
    own = elements.select(*keys, F.col("element").alias("node"), F.col("element_type").alias("kind"), F.lit("uml").alias("origin")).distinct()
    ends = edges.select(*keys, F.col("src").alias("node")).unionByName(edges.select(*keys, F.col("dst").alias("node"))).distinct()
    implied = ends.join(own, [*keys, "node"], "left_anti").select(*keys, "node", F.lit("class").alias("kind"), F.lit("uml-implied").alias("origin"))
    return own.unionByName(implied), edges
