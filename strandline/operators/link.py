"""Linking: symbols, imports, calls and inheritance of a repository joined into edges.

Everything is per repo_id. Where the first or last of several candidates counts, the order is that of node_seq (symbols)
and of the path (files). Lookup tables are reduced to one row a key before they are joined, so a common name costs no
more than its calls.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Extensions in the order in which they are tried, and roots of source trees.
EXTENSIONS, ROOTS = (".py", ".ts", ".tsx", ".js", ".jsx", ".java", ".go", ".rs"), ("src", "lib", "app", "pkg")


def symbol_rows(symbols: DataFrame) -> DataFrame:
    return symbols.where("id is not null").select("repo_id", "id", "name", "qualified_name", "kind", "file_path", "param_types", F.col("symbol_seq").alias("node_seq"))


def modules(rows: DataFrame) -> DataFrame:
    """(repo_id, file_path, module_id): the first module symbol of each file."""
    return rows.where("kind = 'module'").groupBy("repo_id", "file_path").agg(F.min_by("id", "node_seq").alias("module_id"))


def _scope(q: Column) -> Column:
    return F.regexp_replace(q, r"(^|\.)[^.]*$", "")


def contains(rows: DataFrame) -> DataFrame:
    """(repo_id, src, dst): classes to their methods, modules to what is at the top of a file."""
    distinct = rows.where("kind <> 'module'").groupBy("repo_id", "id").agg(F.max_by(F.struct("qualified_name", "kind", "file_path"), "node_seq").alias("a")).select("repo_id", "id", "a.*")
    dotted = F.col("qualified_name").contains(".")
    parent = F.when((F.col("kind") == "method") & dotted, F.concat("file_path", F.lit("::"), _scope(F.col("qualified_name"))))
    wanted = distinct.where(dotted == (F.col("kind") == "method")).withColumn("parent", parent)
    ids = rows.select("repo_id", F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    found = wanted.join(ids, ["repo_id", "parent"], "left").join(modules(rows), ["repo_id", "file_path"], "left")
    module = F.coalesce("module_id", F.concat("file_path", F.lit("::<module>")))
    return found.select("repo_id", F.when(F.col("known"), F.col("parent")).otherwise(module).alias("src"), F.col("id").alias("dst"))


def _located(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (one an import) with target_file, the file that it names; those of which none is found are left out."""
    paths = files.select("repo_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("target_file")).where("target_file <> ''").distinct()
    src = F.col("source_module")
    module = F.replace(F.regexp_replace(src, r"^(@/|~/)", ""), F.lit("."), F.lit("/"))
    folder = F.regexp_replace("file_path", r"/?[^/]*$", "")
    dots = F.length(F.regexp_extract(src, r"^\.+", 0))
    levels = F.filter(F.split(folder, "/"), lambda x: x != "")
    up = F.array_join(F.slice(levels, F.lit(1), F.greatest(F.lit(0), F.size(levels) - dots + 1)), "/")
    relative = F.regexp_replace(F.concat(up, F.lit("/"), F.replace(F.regexp_replace(src, r"^\.+", ""), F.lit("."), F.lit("/"))), r"^/+|/+$", "")
    is_relative = src.startswith(".")
    rows = rows.select("*", module.alias("_module"), F.when(is_relative, relative).otherwise(module).alias("_base"), F.when(~is_relative, F.concat(folder, F.lit("/"), module)).alias("_near"), is_relative.alias("_relative"))
    rows = rows.withColumn("_tail", F.regexp_replace("_module", r"^.*/", ""))

    # what a file can be called by: its path without the form that ends it, or also without the root that begins it. An
    # import tries the plain name (0), the one in its own folder (1), then the roots (2 on); in each the forms in order
    forms = list(dict.fromkeys(f for e in EXTENSIONS for f in (e, f"/index{e}", "/__init__.py", "/mod.rs")))
    ended = F.filter(F.array(*(F.struct(F.lit(i).alias("f"), F.lit(f).alias("form")) for i, f in enumerate(forms))), lambda x: F.endswith("target_file", x["form"]))
    called = paths.select("repo_id", "target_file", F.explode(ended).alias("x")).select("repo_id", "target_file", "x.f", F.substring("target_file", F.lit(1), F.length("target_file") - F.length("x.form")).alias("base"))
    rooted = (F.when(F.startswith("base", F.lit(f"{r}/")), F.struct(F.substring("base", F.lit(len(r) + 2), F.length("base")).alias("key"), F.lit(2 + i).alias("c"))) for i, r in enumerate(ROOTS))
    called = called.select("repo_id", "target_file", "f", F.explode(F.filter(F.array(F.struct(F.col("base").alias("key"), F.lit(0).alias("c")), *rooted), lambda x: x.isNotNull())).alias("x"))
    place = F.struct("x.c", "f", "target_file")
    called = called.groupBy("repo_id", F.col("x.key").alias("_key")).agg(F.min(place).alias("any"), F.min(F.when(F.col("x.c") == 0, place)).alias("plain"))
    stem = F.regexp_replace(F.regexp_replace("target_file", r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    by_stem = paths.groupBy("repo_id", stem.alias("_tail")).agg(F.min("target_file").alias("same_stem"))
    # endings of names that no import asks for are left out before they are shuffled
    asked = cut(rows.where(~F.col("_module").contains("/")).select("repo_id", "_tail").distinct())
    endings = F.transform(F.sequence(F.lit(1), F.length("stem")), lambda i: F.substring("stem", i, F.length("stem")))
    by_ending = paths.where(F.endswith("target_file", F.lit(".py"))).select("repo_id", "target_file", stem.alias("stem")).where("stem <> ''").select("repo_id", "target_file", F.explode(endings).alias("_tail"))
    by_ending = by_ending.join(asked, ["repo_id", "_tail"], "left_semi").groupBy("repo_id", "_tail").agg(F.min("target_file").alias("same_ending"))

    out = rows.join(called.select("repo_id", F.col("_key").alias("_base"), "any", "plain"), ["repo_id", "_base"], "left")
    out = out.join(called.select("repo_id", F.col("_key").alias("_near"), F.col("plain").alias("near")), ["repo_id", "_near"], "left")
    direct = F.when(F.col("_relative"), F.col("plain.target_file")).otherwise(F.coalesce("plain.target_file", "near.target_file", "any.target_file"))
    out = out.withColumn("_direct", direct).drop("_base", "_near", "_relative", "any", "plain", "near")
    out = out.join(by_stem, ["repo_id", "_tail"], "left").join(by_ending, ["repo_id", "_tail"], "left")
    ending = F.when(~F.col("_module").contains("/"), F.col("same_ending"))
    found = out.withColumn("target_file", F.coalesce("_direct", F.least("same_stem", ending))).where("target_file is not null")
    return found.drop("_module", "_tail", "_direct", "same_stem", "same_ending")


def _single_imports(imports: DataFrame) -> DataFrame:
    kept = [c for c in ("source_module", "imported_name", "is_wildcard", "line_number") if c in imports.columns]
    return imports.where("source_module is not null and source_module <> ''").groupBy("import_id").agg(F.first("repo_id").alias("repo_id"), F.first(F.regexp_replace("file_path", r"^(\./)+", "")).alias("file_path"), *(F.first(c).alias(c) for c in kept))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, repo_id, file_path, target_file): the file that an import names, if one is found."""
    return _located(_single_imports(imports), files).select("import_id", "repo_id", "file_path", "target_file")


def import_edges(imports: DataFrame, files: DataFrame, rows: DataFrame, single: bool = False) -> DataFrame:
    """(repo_id, src, dst, line_number, seq): modules to the modules and symbols they import. single: no import is repeated, all paths are clean, and edges to or from files without a module are left out."""
    one = imports.where("source_module is not null and source_module <> ''") if single else _single_imports(imports)
    mod = modules(rows)
    own = _located(one, files).join(mod, ["repo_id", "file_path"], "inner" if single else "left").withColumn("src", F.coalesce("module_id", F.concat("file_path", F.lit("::<module>")))).drop("module_id")
    target = mod.select("repo_id", F.col("file_path").alias("target_file"), F.col("module_id").alias("dst"))
    parts = F.split("qualified_name", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    # the plain cases by themselves, since a lambda a row is slow
    named = F.when(~F.col("qualified_name").contains("."), F.array("name")).otherwise(F.array_distinct(F.array_append(F.slice(ends, F.lit(2), F.size(ends)), F.col("name"))))
    keys = rows.where("qualified_name is not null").select("repo_id", F.col("file_path").alias("target_file"), F.col("id").alias("dst"), F.explode(named).alias("wanted"))
    keys = keys if single else keys.distinct()
    own = cut(own.join(target, ["repo_id", "target_file"], "inner" if single else "left").select("repo_id", "target_file", "src", "dst", "line_number", "imported_name", "is_wildcard", F.col("import_id").alias("seq")))
    edge = ["repo_id", "src", "dst", "line_number", "seq"]
    asking = own.where(~F.coalesce("is_wildcard", F.lit(False)) & (F.col("imported_name") != "")).withColumnRenamed("imported_name", "wanted").drop("dst")
    return own.withColumn("dst", F.coalesce("dst", F.concat("target_file", F.lit("::<module>")))).select(edge).unionByName(asking.join(keys, ["repo_id", "target_file", "wanted"]).select(edge))


def imported_names(imports: DataFrame, rows: DataFrame) -> DataFrame:
    """(repo_id, file_path, key, target): what an imported name stands for, wherever it was imported from."""
    first_two = F.slice(F.sort_array(F.collect_list("o")), 1, 2)
    per_file = rows.groupBy("repo_id", "name", "file_path").agg(F.min(F.struct("node_seq", "id")).alias("m"))
    per_name = per_file.select("repo_id", F.col("name").alias("imported_name"), F.struct("m.node_seq", "m.id", "file_path").alias("o")).groupBy("repo_id", "imported_name").agg(first_two.alias("firsts"))
    asked = imports.where("imported_name is not null").select("repo_id", F.regexp_replace("file_path", r"^(\./)+", "").alias("file_path"), F.coalesce(F.when(F.col("alias") != "", F.col("alias")), F.col("imported_name")).alias("key"), "imported_name", "import_id").distinct()
    return asked.join(per_name, ["repo_id", "imported_name"]).withColumn("target", F.get(F.filter("firsts", lambda x: x["file_path"] != F.col("file_path")), 0)["id"]).where("target is not null").groupBy("repo_id", "file_path", "key").agg(F.max_by("target", "import_id").alias("target"))


def call_edges(calls: DataFrame, imports: DataFrame, symbols: DataFrame, key: Sequence[str] = ("call_id",)) -> DataFrame:
    """(call_id, repo_id, src, dst, rule, line_number): calls resolved by the first rule that holds, calls to oneself aside. key: what tells calls apart."""
    everything = symbol_rows(symbols)
    clean = F.regexp_replace("callee_name", r"^(self|this|super|cls)\.", "")
    last = lambda c: F.substring_index(c, ".", -1)
    # every rule needs a symbol, or a name that was imported, whose last part is that of the call's name: all else is
    # left out before anything is shuffled by its long keys
    imported = F.coalesce(F.when(F.col("alias") != "", F.col("alias")), F.col("imported_name"))
    names = everything.select("repo_id", F.explode(F.array_distinct(F.array(last(F.col("name")), last(F.col("qualified_name"))))).alias("last")).unionByName(imports.select("repo_id", last(imported).alias("last"))).distinct()
    calls = calls.where("callee_name is not null and callee_name <> ''").withColumn("last", last(clean))
    hit = cut(calls.select("repo_id", "last").distinct().join(names, ["repo_id", "last"], "left_semi"))
    one = calls.join(hit, ["repo_id", "last"], "left_semi")
    one = cut(one.groupBy(*key).agg(*(F.first(c).alias(c) for c in ("call_id", "repo_id", "caller_id", "callee_name", "line_number", "file_path") if c not in key)))
    parts = {"_name": last(F.col("name")), "_qual": last(F.col("qualified_name"))}
    rows = everything.withColumns(parts)
    for part in parts:
        rows = rows.join(hit.select("repo_id", F.col("last").alias(part), F.lit(True).alias(f"{part}_hit")), ["repo_id", part], "left")
    rows = cut(rows.where("_name_hit or _qual_hit").select(everything.columns))
    callers = one.select("repo_id", F.col("caller_id").alias("id")).distinct()
    known = everything.join(callers, ["repo_id", "id"], "left_semi").groupBy("repo_id", F.col("id").alias("caller_id")).agg(F.max_by(F.struct("qualified_name", "param_types"), "node_seq").alias("caller"))
    one = one.withColumn("file_path", F.regexp_replace("file_path", r"^(\./)+", "")).join(known, ["repo_id", "caller_id"], "left").withColumn("clean", clean)
    scope = _scope(F.col("caller.qualified_name"))
    one = one.withColumn("sibling", F.when(scope != "", F.concat(scope, F.lit("."), "clean")))
    one = one.withColumn("obj", F.when(F.col("clean").contains("."), F.substring_index("clean", ".", 1))).withColumn("member", F.when(F.col("obj").isNotNull(), F.substring(F.col("clean"), F.length("obj") + 2, F.length("clean"))))
    hint = F.element_at("caller.param_types", F.col("obj"))
    one = one.withColumn("hint", F.when(F.col("obj").isNotNull() & hint.isNotNull(), F.regexp_replace(hint, r"^.*\.", ""))).withColumn("typed", F.concat("hint", F.lit("."), "member"))

    latest = F.max_by("id", "node_seq")
    by_qual = rows.groupBy("repo_id", "file_path", "qualified_name").agg(latest.alias("t"))
    by_name = rows.groupBy("repo_id", "file_path", "name").agg(latest.alias("t"))
    # imports under a name that a call of their file begins with or is
    begun = cut(one.select("repo_id", "file_path", F.explode(F.array_distinct(F.array("clean", "obj"))).alias("_key")).where("_key is not null").distinct())
    used = imports.withColumns({"file_path": F.regexp_replace("file_path", r"^(\./)+", ""), "_key": imported}).join(begun, ["repo_id", "file_path", "_key"], "left_semi").drop("_key")
    used = cut(used.select("import_id", "repo_id", "file_path", "imported_name", "alias"))
    names = cut(imported_names(used, everything.join(used.select("repo_id", F.col("imported_name").alias("name")).distinct(), ["repo_id", "name"], "left_semi")))
    methods = rows.where("kind = 'method'")
    typed = methods.groupBy("repo_id", F.col("qualified_name").alias("typed")).agg(F.min_by("id", "node_seq").alias("t4a"))
    started = methods.where(F.col("qualified_name").contains(".")).groupBy("repo_id", F.substring_index("qualified_name", ".", 1).alias("hint"), F.col("name").alias("member")).agg(F.min_by("id", "node_seq").alias("t4b"))
    unique = rows.where("kind <> 'module'").groupBy("repo_id", F.col("name").alias("clean")).agg(F.count("*").alias("n"), F.min("id").alias("t7")).where("n = 1").drop("n")

    out = one.join(by_qual.select("repo_id", "file_path", F.col("qualified_name").alias("sibling"), F.col("t").alias("t1")), ["repo_id", "file_path", "sibling"], "left")
    out = out.join(by_name.select("repo_id", "file_path", F.col("name").alias("clean"), F.col("t").alias("t2")), ["repo_id", "file_path", "clean"], "left")
    out = out.join(by_qual.select("repo_id", "file_path", F.col("qualified_name").alias("clean"), F.col("t").alias("t2b")), ["repo_id", "file_path", "clean"], "left")
    out = out.join(names.select("repo_id", "file_path", F.col("key").alias("clean"), F.col("target").alias("t3")), ["repo_id", "file_path", "clean"], "left")
    out = out.join(typed, ["repo_id", "typed"], "left").join(started, ["repo_id", "hint", "member"], "left")
    # a member of what the object was imported as
    targets = names.select("repo_id", F.col("target").alias("id")).distinct()
    classes = everything.join(targets, ["repo_id", "id"], "left_semi").groupBy("repo_id", F.col("id").alias("target")).agg(F.max_by(F.struct("qualified_name", "file_path"), "node_seq").alias("c"))
    members = names.join(classes, ["repo_id", "target"]).select("repo_id", "file_path", F.col("key").alias("obj"), F.col("c.qualified_name").alias("oq"), F.col("c.file_path").alias("of"))
    first_qual = rows.groupBy("repo_id", F.col("file_path").alias("of"), F.col("qualified_name").alias("mq")).agg(F.min_by("id", "node_seq").alias("t5"))
    out = out.join(members, ["repo_id", "file_path", "obj"], "left").withColumn("mq", F.concat("oq", F.lit("."), "member")).join(first_qual, ["repo_id", "of", "mq"], "left")
    # a method whose class is like the object: over distinct objects and classes of a name only
    owners = methods.groupBy("repo_id", F.col("name").alias("member"), F.lower(F.substring_index("qualified_name", ".", 1)).alias("owner")).agg(F.min(F.struct("node_seq", "id")).alias("m"))
    asked = out.where("obj is not null and coalesce(t1, t2, t2b, t3, t4a, t4b, t5) is null").select("repo_id", "obj", "member").distinct()
    low = F.lower("obj")
    fuzzy = asked.join(owners, ["repo_id", "member"]).where(F.contains("owner", low) | F.contains(low, F.col("owner"))).groupBy("repo_id", "obj", "member").agg(F.min("m").alias("m")).select("repo_id", "obj", "member", F.col("m.id").alias("t6"))
    out = out.join(fuzzy, ["repo_id", "obj", "member"], "left").join(unique, ["repo_id", "clean"], "left")
    order = ["t1", "t2", "t2b", "t3", "t4a", "t4b", "t5", "t6", "t7"]
    labels = ["sibling", "local name", "local qualified name", "imported name", "typed receiver", "typed receiver", "imported member", "similar class", "unique name"]
    rule = F.coalesce(*(F.when(F.col(t).isNotNull(), F.lit(r)) for t, r in zip(order, labels)))
    return out.select("call_id", "repo_id", F.col("caller_id").alias("src"), F.coalesce(*order).alias("dst"), rule.alias("rule"), "line_number").where("dst is not null and dst <> src")


def inheritance_edges(inheritance: DataFrame, symbols: DataFrame, key: Sequence[str] = ("inherit_id",)) -> DataFrame:
    """(inherit_id, repo_id, src, dst, edge_type): children to the class or interface of the parent's name, of the same file first."""
    rows = symbol_rows(symbols).where(F.col("kind").isin("class", "interface"))
    anywhere = rows.groupBy("repo_id", F.col("name").alias("parent")).agg(F.min_by("id", "node_seq").alias("any"))
    here = rows.groupBy("repo_id", "file_path", F.col("name").alias("parent")).agg(F.min_by("id", "node_seq").alias("own"))
    one = inheritance.where("parent_name is not null and child_id is not null").groupBy(*key).agg(*(F.first(c).alias(c) for c in ("inherit_id", "repo_id", "child_id", "parent_name", "relation", "file_path") if c not in key))
    one = one.withColumn("parent", F.regexp_replace("parent_name", r"^.*\.", "")).withColumn("file_path", F.regexp_replace("file_path", r"^(\./)+", ""))
    out = one.join(here, ["repo_id", "file_path", "parent"], "left").join(anywhere, ["repo_id", "parent"], "left")
    return out.select("inherit_id", "repo_id", F.col("child_id").alias("src"), F.coalesce("own", "any").alias("dst"), F.col("relation").alias("edge_type")).where("dst is not null")


_PAIR = ("repo_id", "src", "dst")


def _last(edges: DataFrame) -> DataFrame:
    """One row a (repo_id, src, dst): the last by pass, then seq."""
    last = F.max_by(F.struct("edge_type", "line_number"), F.struct("pass", "seq")).alias("a")
    return edges.groupBy(*_PAIR).agg(last).select(*_PAIR, "a.*")


def _later(imports: DataFrame, calls: DataFrame, inheritance: DataFrame) -> DataFrame:
    none = F.lit(None).cast("int")
    return (
        imports.select(*_PAIR, F.lit("IMPORTS").alias("edge_type"), "line_number", F.lit(1).alias("pass"), "seq")
        .unionByName(calls.select(*_PAIR, F.lit("CALLS").alias("edge_type"), "line_number", F.lit(2).alias("pass"), F.col("call_id").alias("seq")))
        .unionByName(inheritance.select(*_PAIR, "edge_type", none.alias("line_number"), F.lit(3).alias("pass"), F.col("inherit_id").alias("seq")))
    )


def _contained(pairs: DataFrame) -> DataFrame:
    return pairs.select(*_PAIR, F.lit("CONTAINS").alias("edge_type"), F.lit(None).cast("int").alias("line_number"))


def build(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(repo_id, src, dst, edge_type, line_number): all edges, in the order containment, imports, calls, inheritance; the last of a pair wins."""
    rows = symbol_rows(symbols)
    first = _contained(contains(rows)).withColumns({"pass": F.lit(0), "seq": F.lit(0).cast("bigint")})
    edges = _last(first.unionByName(_later(import_edges(imports, files, rows), call_edges(calls, imports, symbols), inheritance_edges(inheritance, symbols))))
    ids = rows.select("repo_id", "id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), ["repo_id", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["repo_id", "dst"], "left_semi")


def build_extracted(files: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame, inheritance: DataFrame, contained: DataFrame) -> DataFrame:
    """As build, of what extract.linked() gives: no row is repeated, paths are clean, callers, children and contained are known within their file."""
    rows = symbol_rows(symbols)
    by_call, by_child = (("repo_id", "file_path", k) for k in ("call_id", "inherit_id"))
    later = cut(_last(_later(import_edges(imports, files, rows, single=True), call_edges(calls, imports, symbols, by_call), inheritance_edges(inheritance, symbols, by_child))))
    # containment is never shuffled but where later edges lie within one file
    within = later.where(F.substring_index("src", "::", 1) == F.substring_index("dst", "::", 1)).select(*_PAIR)
    return later.unionByName(_contained(contained).join(within, list(_PAIR), "left_anti"))
