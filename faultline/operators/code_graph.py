"""From source files to a code graph: directories, files, classes and functions, and what contains, imports, inherits and invokes what.

Only reading a file's syntax needs Python, a task a batch of files; names are resolved by joins. files: graph, path, content.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, stored

#: Folders that are not read, by a part of their name.
SKIPPED = (".github", ".git", "__pycache__", ".pytest_cache", "node_modules")
_FIELDS = ("row", "owner", "name", "type", "code", "start_line", "end_line", "module", "alias")


class _Reader:
    """Rows of one file: row is node, import, call or base; owner is the node they belong to."""

    def __init__(self, path: str, content: str):
        self.path, self.content, self.rows = path, content, []
        tree = ast.parse(content)
        self.lines = re.findall(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+", content)  # split once: a form feed ends no line
        for x in ast.walk(tree):
            self._imports(path, x)
        self._scope(tree, [], None)

    def _code(self, x: ast.AST) -> str:
        """ast.get_source_segment, which would split the whole file for each node. Places in a line are counted in bytes."""
        lines = self.lines[x.lineno - 1 : x.end_lineno]
        lines[-1] = lines[-1].encode()[: x.end_col_offset].decode()
        lines[0] = lines[0].encode()[x.col_offset :].decode()
        return "".join(lines)

    def _add(self, row: str, owner: str, **values: object) -> None:
        self.rows.append({**dict.fromkeys(_FIELDS), "row": row, "owner": owner, **values})

    def _imports(self, owner: str, x: ast.AST) -> None:
        if isinstance(x, ast.Import):
            for a in x.names:
                self._add("import", owner, module=a.name, alias=a.asname)
        elif isinstance(x, ast.ImportFrom):
            base = [] if not x.level else self.path.split("/")[: -x.level] if len(self.path.split("/")) >= x.level else []
            module = ".".join([*base, *([x.module] if x.module else [])])
            star = any(a.name == "*" for a in x.names)
            for a in x.names[:1] if star else x.names:
                self._add("import", owner, module=module, name="*" if star else a.name, alias=None if star else a.asname)

    def _scope(self, node: ast.AST, above: list[str], kind: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                if kind == "class" and isinstance(x, ast.FunctionDef) and x.name == "__init__":
                    continue
                own = [*above, x.name]
                name, is_class = f"{self.path}:{'.'.join(own)}", isinstance(x, ast.ClassDef)
                self._add("node", name, name=x.name, type="class" if is_class else "function", code=self._code(x), start_line=x.lineno, end_line=x.end_lineno)
                for y in ast.iter_child_nodes(x):
                    self._imports(name, y)
                if is_class:
                    self._class(name, x)
                else:
                    self._calls(name, x)
                self._scope(x, own, "class" if is_class else "function")
            else:
                self._scope(x, above, kind)

    def _call(self, owner: str, x: ast.AST) -> None:
        if isinstance(x, ast.Call) and isinstance(x.func, ast.Name | ast.Attribute):
            self._add("call", owner, name=x.func.id if isinstance(x.func, ast.Name) else x.func.attr)

    def _calls(self, owner: str, node: ast.AST) -> None:
        for x in ast.iter_child_nodes(node):
            if not isinstance(x, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                self._call(owner, x)
                self._calls(owner, x)

    def _class(self, owner: str, node: ast.ClassDef) -> None:
        for b in node.bases:
            if isinstance(b, ast.Name | ast.Attribute):
                self._add("base", owner, name=b.id if isinstance(b, ast.Name) else b.attr)
        for x in node.body:
            if isinstance(x, ast.FunctionDef) and x.name == "__init__":
                for y in ast.iter_child_nodes(x):
                    self._imports(owner, y)
                for y in ast.walk(x):
                    self._call(owner, y)
                break


def read_files(files: DataFrame) -> DataFrame:
    """The raw rows of all Python files outside skipped folders: graph, path, hash, ok and the fields of _Reader; a file's own row is 'file'.

    Files that do not parse give their own row alone, with ok false.
    """
    ship(files.sparkSession)
    skipped = F.exists(F.split(F.regexp_replace("path", r"/?[^/]*$", ""), "/"), lambda d: F.lit(False) if not SKIPPED else F.exists(F.array(*[F.lit(s) for s in SKIPPED]), lambda s: d.contains(s)))
    rows = files.where(F.col("path").endswith(".py") & ~skipped).select("graph", "path", "content")
    kind = files.schema["graph"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for graph, path, content in zip(*[c.to_pylist() for c in b.columns], strict=True):
                try:
                    found, ok = _Reader(path, content or "").rows, True
                except (SyntaxError, ValueError, RecursionError):
                    found, ok = [], False
                out.append({**dict.fromkeys(_FIELDS), "graph": graph, "path": path, "ok": ok, "row": "file", "owner": path, "code": content})
                out += [{**r, "graph": graph, "path": path, "ok": ok} for r in found]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([b.schema.field(0).with_name("graph"), ("path", pa.string()), ("ok", pa.bool_()), *[(f, pa.int64() if f.endswith("_line") else pa.string()) for f in _FIELDS]]))

    schema = f"graph {kind}, path string, ok boolean, " + ", ".join(f"{f} {'bigint' if f.endswith('_line') else 'string'}" for f in _FIELDS)
    return rows.mapInArrow(read, schema).withColumn("hash", F.when(F.col("row") == "file", F.md5("code")))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose content a former reading (rows of read_files) does not have; the rows of the others can be used again."""
    same = known.where("row = 'file'").select("graph", "path", "hash")
    return files.withColumn("hash", F.md5("content")).join(same, ["graph", "path", "hash"], "left_anti").drop("hash")


def reread(files: DataFrame, known: DataFrame) -> DataFrame:
    """read_files(files), with the rows of unchanged files taken from a former reading."""
    kept = files.select("graph", "path", F.md5("content").alias("__h"))
    same = known.join(known.where("row = 'file'").select("graph", "path", F.col("hash").alias("__h")).join(kept, ["graph", "path", "__h"]).select("graph", "path"), ["graph", "path"], "left_semi")
    return same.unionByName(read_files(changed_files(files, known)))


def _folders(path: Column) -> Column:
    """All folders above a path, '/' first."""
    parts = F.split(F.regexp_replace(path, r"/?[^/]*$", ""), "/")
    names = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.concat(F.array(F.lit("/")), F.filter(names, lambda x: x != ""))


def build(rows: DataFrame, global_names: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (graph, node, type, code, hash, start_line, end_line) and edges (graph, src, dst, type, alias) from the stored rows of read_files.

    Calls and base classes bind to all visible nodes of their name: those in the scopes around the caller, in what its file imports, and in
    what packages it imports pass on; also to aliases. global_names: names that nothing visible has bind to all nodes of that name.
    """
    rows = stored(rows.where("ok"))
    nodes = stored(nodes_of(rows))
    return nodes, _edges(rows, nodes, global_names)


def nodes_of(rows: DataFrame) -> DataFrame:
    """graph, node, type, code, hash, start_line, end_line: the nodes alone, which need no names resolved; rows: of read_files."""
    rows = rows.where("ok")
    files = rows.where("row = 'file'").select("graph", F.col("owner").alias("node"), F.lit("file").alias("type"), "code", "hash", "start_line", "end_line")
    inner = rows.where("row = 'node'").select("graph", F.col("owner").alias("node"), "type", "code", "hash", "start_line", "end_line").dropDuplicates(["graph", "node"])
    dirs = files.select("graph", F.explode(_folders(F.col("node"))).alias("node")).distinct()
    return dirs.select("graph", "node", F.lit("directory").alias("type"), *[F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("hash", "string"), ("start_line", "long"), ("end_line", "long"))]).unionByName(files).unionByName(inner)


def _edges(rows: DataFrame, nodes: DataFrame, global_names: bool) -> DataFrame:
    kinds = nodes.select("graph", "node", "type")

    up = F.when(F.col("type").isin("class", "function"), F.when(F.regexp_extract("node", ":(.*)$", 1).contains("."), F.regexp_replace("node", r"\.[^.:]*$", "")).otherwise(F.substring_index("node", ":", 1))).when(F.col("node").contains("/") & (F.col("node") != "/"), F.regexp_replace("node", "/[^/]*$", "")).when(F.col("node") != "/", "/")
    contains = stored(kinds.select("graph", up.alias("src"), F.col("node").alias("dst")).where("src is not null"))

    imports = stored(_imports(rows, kinds))
    # inner nodes of a scope: what it contains, and what classes among these contain
    child = contains.join(kinds.withColumnRenamed("node", "src"), ["graph", "src"]).select("graph", F.col("src").alias("scope"), F.col("dst").alias("node"), (F.col("type") == "class").alias("through")).where(~F.col("scope").endswith("/"))
    child = stored(child.join(kinds.where("type in ('class', 'function')").select("graph", "node"), ["graph", "node"], "left_semi"))
    scopes, last = child.select("graph", "scope", "node"), child.select("graph", "scope", "node")
    classes = kinds.where("type = 'class'").select("graph", F.col("node").alias("scope"))
    nested = stored(child.join(classes, ["graph", "scope"], "left_semi").select("graph", F.col("scope").alias("mid"), F.col("node").alias("deep")))
    while True:  # classes in classes, as deep as they go: a node lies in one place, so this ends
        last = stored(last.join(nested, (last["graph"] == nested["graph"]) & (last["node"] == nested["mid"])).select(last["graph"], "scope", F.col("deep").alias("node")))
        if last.isEmpty():
            break
        scopes = scopes.unionByName(last)
    scopes = stored(scopes.distinct())

    callers = kinds.where("type in ('class', 'function')").select("graph", F.col("node").alias("caller"), F.substring_index("node", ":", 1).alias("file"))
    names = F.split(F.regexp_extract("caller", ":(.*)$", 1), r"\.")
    chain = F.concat(F.array("file"), F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.concat(F.col("file"), F.lit(":"), F.array_join(F.slice(names, F.lit(1), i), "."))))
    # what a file may use of others: its own imports and those of packages that it reaches through __init__ files
    reach = stored(_packages(imports, kinds))
    used = reach.join(imports.withColumnRenamed("src", "via"), ["graph", "via"]).join(kinds.withColumnRenamed("node", "dst"), ["graph", "dst"])
    passed = used.where("type in ('function', 'class')").select("graph", "file", F.col("dst").alias("node")).unionByName(used.where("type in ('file', 'class')").select("graph", "file", F.col("dst").alias("scope")).join(scopes, ["graph", "scope"]).select("graph", "file", "node"))
    passed = passed.unionByName(reach.where("via <> file").select("graph", "file", F.col("via").alias("scope")).join(scopes, ["graph", "scope"]).select("graph", "file", "node"))
    short = F.substring_index(F.substring_index("node", ":", -1), ".", -1)
    aliased = used.where("alias is not null").select("graph", "file", F.col("alias").alias("name"), F.col("dst").alias("node"))
    by_file = stored(passed.select("graph", "file", short.alias("name"), "node").unionByName(aliased).distinct())

    wanted = stored(rows.where("row in ('call', 'base')").select("graph", F.col("owner").alias("caller"), F.substring_index("owner", ":", 1).alias("file"), "name", F.when(F.col("row") == "call", "invokes").otherwise("inherits").alias("type")).distinct())
    # a name is looked up in the scopes around its caller: all nodes of these for each caller would be the square of a file
    named = scopes.select("graph", "scope", short.alias("name"), "node").distinct()
    around = wanted.join(callers, ["graph", "caller", "file"]).withColumn("chain", chain)
    by_caller = around.select("graph", "caller", "name", "type", "chain", F.explode("chain").alias("scope")).join(named, ["graph", "scope", "name"]).where("not array_contains(chain, node)")
    bound = stored(by_caller.select("graph", "caller", "name", "type", "node").unionByName(wanted.join(by_file, ["graph", "file", "name"]).select("graph", "caller", "name", "type", "node")).distinct())
    if global_names:
        everywhere = kinds.select("graph", short.alias("name"), "node")
        lost = wanted.join(bound.select("graph", "caller", "name").distinct(), ["graph", "caller", "name"], "left_anti")
        bound = bound.unionByName(lost.join(everywhere, ["graph", "name"]).select("graph", "caller", "name", "type", "node"))
    none = F.lit(None).cast("string").alias("alias")
    edges = contains.select("graph", "src", "dst", F.lit("contains").alias("type"), none).unionByName(imports.select("graph", "src", "dst", F.lit("imports").alias("type"), "alias")).unionByName(bound.select("graph", F.col("caller").alias("src"), F.col("node").alias("dst"), "type", none).distinct())
    return edges


def _imports(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """graph, src, dst, alias: what imports resolve to: a submodule before an entity of the module, the entity before the module's file."""
    modules = kinds.where("type = 'file'").select("graph", F.regexp_replace(F.regexp_replace("node", r"(^|/)__init__\.py$", ""), r"\.py$", "").alias("m"), "node")
    files = modules.select("graph", F.replace("m", F.lit("/"), F.lit(".")).alias("module"), F.col("node").alias("file"), F.col("node").endswith("__init__.py").cast("int").alias("p"))
    files = files.groupBy("graph", "module").agg(F.min_by("file", "p").alias("file"))  # a module before a package of its name
    raw = rows.where("row = 'import'").select("graph", F.col("owner").alias("src"), "module", F.col("name").alias("entity"), "alias").distinct()
    asked = raw.withColumn("sub", F.when(F.col("entity").isNotNull() & (F.col("entity") != "*"), F.concat_ws(".", F.nullif("module", F.lit("")), "entity")))
    found = asked.join(files.select("graph", F.col("module").alias("sub"), F.col("file").alias("sub_file")), ["graph", "sub"], "left").join(files, ["graph", "module"], "left")
    found = found.withColumn("entity_node", F.concat("file", F.lit(":"), "entity"))
    known = kinds.select("graph", F.col("node").alias("entity_node"), F.lit(True).alias("has"))
    out = found.join(known, ["graph", "entity_node"], "left")
    return out.select("graph", "src", F.coalesce("sub_file", F.when(F.col("has"), F.col("entity_node")), "file").alias("dst"), "alias").where("dst is not null").distinct()


def _packages(imports: DataFrame, kinds: DataFrame) -> DataFrame:
    """graph, file, via: each file with itself and the __init__ files that it reaches through imports of such files."""
    out = kinds.where("type = 'file'").select("graph", F.col("node").alias("file"), F.col("node").alias("via"))
    step = stored(imports.where(F.col("dst").endswith("__init__.py")).select("graph", F.col("src").alias("via"), F.col("dst").alias("next")).distinct())
    last = out
    while True:  # until nothing new is reached
        near = last.join(step, ["graph", "via"]).select("graph", "file", F.col("next").alias("via")).distinct()
        last = stored(near.join(out, ["graph", "file", "via"], "left_anti"))
        if last.isEmpty():
            return out
        out = stored(out.unionByName(last))
