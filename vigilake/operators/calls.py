"""Calls and chunks of source files, the rules that calls meet, hooks of a tree, and snippets around a line.

Python is parsed with the standard library, other languages are read by a lexer (its docstring says how closely). Files
are read one by one, in Arrow batches; all after it is joins with small rule tables and column expressions. Files that
cannot be read that way, are null, empty or of no known language give no rows: errors() names them, and the line scan is
what is left for them. PHP has no calls here, only chunks: its hooks come from the line scan.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from .hooks import language_of, scan_lines
from .intervals import SLAB, innermost
from .lexer import LANGUAGES, Call, Chunk, Source

AROUND = 2
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DECORATED = (*_FUNCTIONS, ast.ClassDef)


def _parsed(content: str) -> ast.AST | str:
    """The tree, or why there is none."""
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return f"Parse error: {type(e).__name__}"


def _callee(node: ast.expr) -> str | None:
    """The last name of what is called; of a call's result, the name of that call."""
    while isinstance(node, ast.Call):
        node = node.func
    return node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None


def _walk(root: ast.AST) -> Iterator[tuple[ast.AST, ast.AST | None, str | None]]:
    """Nodes with their innermost enclosing function and class, without recursion. Decorators are outside of what they decorate."""
    todo: list = [(root, None, None)]
    while todo:
        node, func, cls = todo.pop()
        yield node, func, cls
        inside = (node, cls) if isinstance(node, _FUNCTIONS) else (func, node.name) if isinstance(node, ast.ClassDef) else (func, cls)
        outside = {id(x) for x in node.decorator_list} if isinstance(node, _DECORATED) else ()
        todo += [(child, *((func, cls) if id(child) in outside else inside)) for child in reversed(list(ast.iter_child_nodes(node)))]


def _python_calls(tree: ast.AST) -> Iterator[Call]:
    for node, func, _ in _walk(tree):
        if isinstance(node, ast.Call) and (name := _callee(node.func)):
            yield Call(name, func.name if func else None, func.lineno if func else 0, node.lineno, node.end_lineno)


def _python_chunks(tree: ast.AST, content: str) -> Iterator[Chunk]:
    lines = [line.encode() for line in content.split("\n")]

    def text(line: int, column: int, end_line: int, end_column: int) -> str:
        part = lines[line - 1 : end_line]
        part[-1] = part[-1][:end_column]
        part[0] = part[0][column:]
        return b"\n".join(part).decode("utf-8", "replace")

    first = lambda n: min([n, *getattr(n, "decorator_list", ())], key=lambda x: (x.lineno, x.col_offset))
    for node, _, cls in _walk(tree):
        if not isinstance(node, _DECORATED):
            continue
        ends = node.end_lineno, node.end_col_offset
        if node.decorator_list:  # a decorated definition is a chunk of its own around the definition
            at = first(node)
            whole = text(at.lineno, at.col_offset - 1, *ends)
            yield Chunk("function", "<unknown>", cls, whole.split("\n")[0].strip(), at.lineno, ends[0], whole)
        body = first(node.body[0])
        column = body.col_offset - (body is not node.body[0])
        signature = text(node.lineno, node.col_offset, *ends).split("\n")[0].strip()
        yield Chunk("class" if isinstance(node, ast.ClassDef) else "function", node.name, cls, signature, node.lineno, ends[0], text(body.lineno, column, *ends))


def _read(content: str | None, language: str | None) -> ast.AST | Source | str:
    """What a file's rows are made of, or why there are none."""
    if content is None:
        return "No content"
    if language == "python":
        return _parsed(content.replace("\r\n", "\n"))
    return Source(content, language) if language in LANGUAGES else "Unsupported file type"


def _named(language: str) -> frozenset[str]:
    """Names that a rule of the language names."""
    return frozenset(name for *_, names in R.CALLS.get(language, ()) for name in names)


def _found_calls(read: ast.AST | Source, language: str) -> Iterator[Call]:
    return _python_calls(read) if language == "python" else iter(()) if language == "php" else iter(read.calls())


def _calls(read: ast.AST | Source, content: str, language: str) -> Iterator[tuple]:
    """Each call; with the lines around it where a rule names what is called."""
    named, lines = _named(language), content.split("\n")
    for call in _found_calls(read, language):
        yield *call, snippet(lines, call.line_start, call.line_end) if call.called in named else None


def snippet(lines: list[str], first: int, last: int, around: int = AROUND) -> str:
    """Lines around a place (from 1), numbered, its first line marked."""
    begin, end = max(first - around, 1), min(last + around, len(lines))
    return "\n".join(f"{'>>>' if n == first else '   '}{n:4d}  {lines[n - 1]}" for n in range(begin, end + 1))


def _chunks(read: ast.AST | Source, content: str, language: str) -> Iterator[Chunk]:
    return _python_chunks(read, content.replace("\r\n", "\n")) if language == "python" else iter(read.chunks())


def _errors(read: ast.AST | Source | str, _content: str, _language: str) -> Iterator[tuple[str]]:
    return iter([(read,)] if isinstance(read, str) else [])


def _mapped(files: DataFrame, rows_of: Callable, columns: str) -> DataFrame:
    """files (path, content, and language if it is known): path, language and the columns of each row that rows_of makes of a file."""
    language = F.col("language") if "language" in files.columns else language_of(F.col("path"))
    names = [c.split(" ")[0] for c in columns.split(", ")]
    types = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[c.split(" ")[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, lang, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                read = _read(content, lang)
                rows = list(rows_of(read, content, lang)) if rows_of is _errors or not isinstance(read, str) else []
                if rows:
                    same = [pa.array([x] * len(rows), pa.string()) for x in (path, lang)]
                    yield pa.record_batch([*same, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], ["path", "language", *names])

    return files.select("path", language.alias("language"), "content").mapInArrow(run, f"path string, language string, {columns}")


def calls(files: DataFrame) -> DataFrame:
    """files (path, content): each call: what is called, the function around it (null outside of functions) and its line, first and last line.

    snippet is the lines around it where a rule of the language names what is called, else null.
    """
    return _mapped(files, _calls, "called string, enclosing string, func_line int, line_start int, line_end int, snippet string")


_LINE = 1 << 20  # columns of a line on the axis of places


def _marks(read: ast.AST | Source, _content: str, language: str) -> Iterator[tuple]:
    """Calls and the functions that can be around them, by place in the file; a call has no last place."""
    if language == "python":
        for node, _, _ in _walk(read):
            if isinstance(node, ast.Call) and (name := _callee(node.func)):
                yield name, node.lineno * _LINE + node.col_offset, None, node.lineno, node.end_lineno
            elif isinstance(node, _FUNCTIONS):
                yield node.name, node.lineno * _LINE + node.col_offset, node.end_lineno * _LINE + node.end_col_offset - 1, node.lineno, node.end_lineno
    elif language != "php":
        for i, name, first, last in read.placed_calls():
            yield name, i * _LINE, None, first, last
        for name, line, first, last in read.functions():
            yield name, first * _LINE, last * _LINE, line, None


def calls_by_sweep(files: DataFrame, slab: int = SLAB) -> DataFrame:
    """files (path, content): path, called, enclosing, func_line, line_start, line_end of each call, as calls() has them.

    The parser tells only where calls and functions stand; the function around a call is found by a sweep over both, in slabs of
    about `slab` lines (of Python) or tokens, so a file of any length is many tasks' work after it is read.
    """
    marks = _mapped(files, _marks, "name string, at long, last long, line_start int, line_end int")
    found = innermost(marks, "path", ["name", "line_start"], slab * _LINE)
    return found.select("path", F.col("name").alias("called"), F.col("around.name").alias("enclosing"), F.coalesce("around.line_start", F.lit(0)).alias("func_line"), "line_start", "line_end")


def chunks(files: DataFrame) -> DataFrame:
    """files (path, content): each function, method and class, nested ones too, with the class around it and an id of path, name and line."""
    rows = _mapped(files, _chunks, "kind string, name string, parent string, signature string, line_start int, line_end int, body string")
    key = F.sha2(F.concat_ws(":", F.col("path"), F.col("name"), F.col("line_start").cast("string")), 256)
    return rows.withColumn("chunk_id", F.substring(key, 1, 12))


def errors(files: DataFrame) -> DataFrame:
    """files (path, content): a row for each file that has neither calls nor chunks because it cannot be read."""
    return _mapped(files, _errors, "error string")


def dangerous(found: DataFrame) -> DataFrame:
    """calls with a row for each rule of the language that names what is called, and the hook's id. The rule table is small and broadcast."""
    rows = [(language, name, n, *rule) for language, table in R.CALLS.items() for n, (*rule, names) in enumerate(table) for name in names]
    table = found.sparkSession.createDataFrame(rows, "language string, called string, rule int, hook_type string, severity string, cwe string, cwe_title string")
    key = F.concat_ws(":", "path", F.coalesce("enclosing", F.lit("None")), F.col("func_line").cast("string"), "hook_type", "called")
    return found.join(F.broadcast(table), ["language", "called"]).withColumns({"func": F.coalesce("enclosing", "called"), "hook_id": F.substring(F.sha2(key, 256), 1, 16)})


def silent(files: DataFrame) -> DataFrame:
    """files (path, language, content) of languages with line rules in which no call meets a rule. Files are read again, not shuffled."""
    scanned = files.where(F.col("language").isin(list(R.GREP_RULES))).select("path", "language", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lang, content in zip(batch.column("language").to_pylist(), batch.column("content").to_pylist()):
                read = _read(content, lang)
                keep.append(isinstance(read, str) or not any(c.called in _named(lang) for c in _found_calls(read, lang)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return scanned.mapInArrow(run, scanned.schema)


def extract(files: DataFrame) -> DataFrame:
    """files (path, language, content): hooks of all files, from calls; from lines for files whose calls give none.

    hook_id, path, language, func, hook_type, severity, cwe, cwe_title, line_start, line_end, called, description, snippet.
    No file moves: what a hook shows is cut where the file is read.
    """
    columns = ["hook_id", "path", "language", "func", "hook_type", "severity", "cwe", "cwe_title", "line_start", "line_end", "called", "description", "snippet"]
    by_call = dangerous(calls(files)).withColumn("description", F.col("cwe_title")).select(columns)
    by_line = scan_lines(silent(files)).withColumns({"func": F.lit(""), "called": F.lit(""), "line_end": F.col("line_start")})
    return by_call.unionByName(by_line.select(columns))


def chunk_summary(files: DataFrame) -> DataFrame:
    """files (path, content): kind, name, n: files with rows or errors, chunks, errors, chunks by kind (0 where there is none) and by language."""
    found, bad = chunks(files), errors(files)
    total = lambda rows, name: rows.agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    with_chunks = found.select("path").distinct()
    out = total(with_chunks.unionByName(bad.select("path")).distinct(), "files_processed").unionByName(total(with_chunks, "files_with_chunks"))
    out = out.unionByName(total(found, "total_chunks")).unionByName(total(bad, "total_errors"))
    kinds = found.sparkSession.createDataFrame([("function",), ("method",), ("class",)], "name string")
    by_kind = kinds.join(found.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n")), "name", "left").select(F.lit("type").alias("kind"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    return out.unionByName(by_kind).unionByName(found.groupBy(F.col("language").alias("name")).agg(F.count("*").alias("n")).select(F.lit("language").alias("kind"), "name", "n"))


def import_lines(content: Column, language: Column) -> Column:
    """Lines of a file that import or include something, trimmed, in order."""
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")
    starts = lambda x, *heads: F.lit(False) if not heads else x.startswith(heads[0]) | starts(x, *heads[1:])
    by = {
        "python": lambda x: starts(x, "import ", "from "),
        "javascript": lambda x: starts(x, "import ", "const ", "var ", "let ") & x.contains("require"),
        "go": lambda x: starts(x, "import ", '"'),
        "cpp": lambda x: starts(x, "#include"),
        "java": lambda x: starts(x, "import "),
    }
    out = F.array().cast("array<string>")
    for name, test in by.items():
        out = F.when(language == name, F.filter(lines, test)).otherwise(out)
    return out


def chunk_contexts(files: DataFrame, with_body: bool = True) -> DataFrame:
    """files (path, content): path, chunk_id, and each chunk as JSON with the imports of its file."""
    language = F.col("language") if "language" in files.columns else language_of(F.col("path"))
    imports = files.select("path", F.to_json(import_lines(F.col("content"), language)).alias("imports"))
    rows = chunks(files).join(imports, "path")
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    fields = {
        "chunk_id": text(F.col("chunk_id")), "file": text(F.col("path")), "language": text(F.col("language")), "name": text(F.col("name")), "signature": text(F.col("signature")), "type": text(F.col("kind")),
        "lines": text(F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))), "parent": text(F.col("parent")), "imports": F.col("imports"),
    }
    fields |= {"body": text(F.col("body"))} if with_body else {}
    made = F.concat(F.lit("{"), *[x for i, (name, value) in enumerate(fields.items()) for x in (F.lit(f'{"," if i else ""}"{name}":'), value)], F.lit("}"))
    return rows.select("path", "chunk_id", made.alias("context"))


def chunk_of_hook(hooks: DataFrame, found: DataFrame) -> DataFrame:
    """hooks (hook_id, path, func) with the first chunk of that name in the file: snippet, line_start and line_end; null where there is none."""
    first = found.groupBy("path", F.col("name").alias("func")).agg(F.min(F.struct("line_start", (-F.col("line_end")).alias("back"), "signature", "body")).alias("c"))
    rows = hooks.select("hook_id", "path", "func").join(first, ["path", "func"], "left")
    snippet = F.substring(F.concat("c.signature", F.lit("\n"), "c.body"), 1, 3000)
    return rows.select("hook_id", "path", "func", F.col("c.line_start").alias("line_start"), (-F.col("c.back")).alias("line_end"), snippet.alias("snippet"))


#: How far a nearby chunk may start, how many are named, and how much of a body is shown.
NEAR_LINES, MOST_NEAR, NEAR_BODY = 50, 3, 600


def nearby(of: DataFrame, found: DataFrame) -> DataFrame:
    """of (hook_id, path, func, line_start) with the first chunks of other names that start within NEAR_LINES of it: place, name, text.

    The band is cut into slots of NEAR_LINES, and a chunk meets only those of its own slot and its two neighbours.
    """
    slot = lambda c: F.floor(c / NEAR_LINES)
    mine = of.where(F.col("line_start").isNotNull()).select("hook_id", "path", "func", F.col("line_start").alias("at"), F.explode(F.array(*[slot(F.col("line_start")) + d for d in (-1, 0, 1)])).alias("slot"))
    others = found.select("path", "name", "kind", "signature", "body", "line_start", "line_end", slot(F.col("line_start")).alias("slot"))
    pairs = mine.join(others, ["path", "slot"]).where((F.col("name") != F.col("func")) & (F.abs(F.col("line_start") - F.col("at")) <= NEAR_LINES))
    lines = F.concat_ws("-", F.col("line_start").cast("string"), F.col("line_end").cast("string"))
    text = F.concat(F.lit("// "), "name", F.lit(" (lines "), lines, F.lit(", type="), "kind", F.lit(")\n"), "signature", F.lit("\n"), F.substring("body", 1, NEAR_BODY))
    first = Window.partitionBy("hook_id", "path").orderBy("line_start", F.desc("line_end"), "name", "text")
    told = pairs.select("hook_id", "path", "name", "line_start", "line_end", text.alias("text"))
    best = told.withColumn("place", F.row_number().over(first)).where(F.col("place") <= MOST_NEAR)  # cut in each task before rows are shuffled
    return best.select("hook_id", "path", "place", "name", "text")


def context(content: Column, line: Column, around: int = AROUND, last: Column | None = None) -> Column:
    """Lines around a line, or from it to another (from 1), numbered, the first of them marked: snippet() as an expression."""
    lines = F.split(content, "\n")
    first = F.greatest(line - around, F.lit(1))
    shown = F.slice(lines, first, F.greatest(F.least((line if last is None else last) + around, F.size(lines)) - first + 1, F.lit(0)))
    # numbers over 9,999 are wider than the column, as %4d has them
    number = lambda n: F.when(n > 9999, n.cast("string")).otherwise(F.lpad(n.cast("string"), 4, " "))
    told = lambda text, i: F.concat(F.when(first + i == line, ">>>").otherwise("   "), number(first + i), F.lit("  "), text)
    return F.array_join(F.transform(shown, told), "\n")
