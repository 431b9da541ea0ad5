"""Parser front end: source files to the node and reference tables of the graph operators.

Python is parsed by its own grammar (module ast); the other languages by a small statement parser: comments and strings
are set aside, statements end at semicolons, line ends and braces (in Ruby at `end`), and each gets the type of its
leading word. Nodes are numbered in preorder and know their depth and the last node below them; variables are found at the leaves and lifted
to every node above them (graph.lifted). A file that cannot be parsed becomes one MODULE node without edges.

A file is parsed whole in one task, in Arrow batches; nothing is gathered across files.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dims, ladders
from ..operators import graph
from ..session import kept

_ROW = "file_id bigint, language string, id bigint, parent_id bigint, last_id bigint, depth int, line bigint, col bigint, ast_type string, code string, is_condition boolean, defines array<string>, uses array<string>, error string"
#: Types of Python syntax nodes that do not follow from the name of their class.
_PYTHON_TYPES = {
    "Module": "module", "FunctionDef": "function_definition", "AsyncFunctionDef": "function_definition", "ClassDef": "class_definition", "If": "if_statement", "For": "for_statement",
    "AsyncFor": "for_statement", "While": "while_statement", "Assign": "assignment", "AugAssign": "augmented_assignment", "AnnAssign": "assignment", "NamedExpr": "named_expression",
    "Return": "return_statement", "Break": "break_statement", "Continue": "continue_statement", "Call": "call", "Import": "import_statement", "ImportFrom": "import_from_statement",
    "Name": "identifier", "Constant": "literal", "Expr": "expression_statement", "arg": "identifier", "arguments": "parameters", "BinOp": "binary_expression", "Compare": "binary_expression",
    "BoolOp": "binary_expression", "Attribute": "attribute", "Subscript": "subscript", "Try": "try_statement", "With": "with_statement",
}
_CONDITIONED = ("if_statement", "while_statement", "for_statement")
#: Leading words of statements and the types they stand for, first match wins.
_STATEMENTS = [
    (r"(?:else\s+|\}\s*else\s+)?(?:if|elsif|elif|unless)\b", "if_statement"),
    (r"else\b", "else_clause"),
    (r"(?:for|foreach)\b", "for_statement"),
    (r"(?:while|until)\b", "while_statement"),
    (r"(?:\w+\s+)*(?:function|func|def)\b", "function_definition"),
    (r"(?:\w+\s+)*(?:class|interface|module|enum)\s", "class_declaration"),
    (r"return\b", "return_statement"),
    (r"break\b", "break_statement"),
    (r"(?:continue|next)\b", "continue_statement"),
    (r"(?:import|require|require_once|include|include_once|use|package)\b", "import_declaration"),
    (r"(?:var|let|const|final)\s", "variable_declaration"),
    (r"(?:(?:public|private|protected|static)\s+)+[\w<>\[\], ]+\([^)]*\)\s*(?:throws [\w, ]+)?$", "method_declaration"),
    (r"[\w.$\[\]'\"@:>-]+(?:\s*,\s*[\w$]+)*\s*(?::=|[-+*/.%|&]?=)(?!=)", "assignment_expression"),
    (r"(?:[A-Z]\w*|int|long|double|float|boolean|char|byte|short)(?:<[^>]*>)?(?:\[\])*\s+\w+\s*(?:=|$)", "variable_declaration"),
    (r"[\w.$:@>-]+\s*\(", "call_expression"),
]
_STATEMENTS = [(re.compile(p), t) for p, t in _STATEMENTS]
_CALL = re.compile(r"[A-Za-z_$][\w$.:>-]*\s*\(")
_WORD = re.compile(r"(?<![\w.])[$@]{0,2}[A-Za-z_]\w*")
_SHAPING = re.compile(r"[()\[\]{};\n]")
_CALLED = re.compile(r"\s*\(")
_OPENS = re.compile(r"^(?:def|class|module|if|unless|while|until|for|case|begin)\b|\bdo(?:\s*\|[^|]*\|)?$")
_KEYWORDS = {x: frozenset(words) for x, words in dims.KEYWORDS.items()}
_LOW_KEYWORDS = {x: frozenset(w.lower() for w in words) for x, words in dims.KEYWORDS.items()}
_BUILTINS = {x: frozenset(words) for x, words in dims.BUILTINS.items()}
#: Rows, and characters of code, after which a task hands on what it has parsed.
_HELD_ROWS, _HELD_CHARS = 20_000, 4 << 20


def _valid(name: str, language: str) -> bool:
    """Whether a name can be a variable: no keyword (in any case), no builtin."""
    return name.lower() not in _KEYWORDS[language] and name not in _BUILTINS[language]


class _Tree:
    """Nodes of one file in preorder."""

    def __init__(self):
        self.rows: list[dict] = []

    def add(self, parent: dict | None, ast_type: str, code: str, line: int, col: int, defines=(), uses=(), condition: bool = False) -> dict:
        row = {"id": len(self.rows), "parent_id": parent["id"] if parent else None, "last_id": len(self.rows), "depth": parent["depth"] + 1 if parent else 0, "line": line, "col": col, "ast_type": ast_type, "code": code.strip(),
               "is_condition": condition, "defines": sorted(set(defines)), "uses": sorted(set(uses)), "error": None}
        self.rows.append(row)
        return row

    def closed(self) -> list[dict]:
        """The rows, each with the last node below it."""
        for row in reversed(self.rows):
            if row["parent_id"] is not None:
                above = self.rows[row["parent_id"]]
                above["last_id"] = max(above["last_id"], row["last_id"])
        return self.rows


def _python(code: str) -> list[dict]:
    tree, lines = _Tree(), code.encode().split(b"\n")

    def text(n: ast.AST) -> str:
        # columns of the grammar are bytes
        a, b = n.lineno - 1, n.end_lineno - 1
        part = lines[a : b + 1]
        part[-1] = part[-1][: n.end_col_offset]
        part[0] = part[0][n.col_offset :]
        return b"\n".join(part).decode("utf-8", "replace")

    def block(parent: dict, body: list, context: ast.AST) -> None:
        if body:
            held = tree.add(parent, "block", "\n".join(text(x) for x in body), body[0].lineno, body[0].col_offset + 1)
            for x in body:
                walk(x, held, context)

    def walk(n: ast.AST, parent: dict | None, context: ast.AST | None) -> None:
        kind = type(n).__name__
        if isinstance(n, ast.Constant) and isinstance(n.value, (str, bytes)):
            return
        if not hasattr(n, "lineno") and kind != "arguments":
            for child in ast.iter_child_nodes(n):
                walk(child, parent, n)
            return
        name = _PYTHON_TYPES.get(kind) or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", kind).lower()
        if kind == "arguments":
            for child in ast.iter_child_nodes(n):
                walk(child, parent, n)
            return
        defines, uses = [], []
        if isinstance(n, ast.Name):
            (defines if isinstance(n.ctx, ast.Store) else uses).extend([n.id] if _valid(n.id, "python") else [])
        elif isinstance(n, ast.arg):
            defines.extend([n.arg] if _valid(n.arg, "python") else [])
        condition = parent is not None and parent["ast_type"] in _CONDITIONED and name in ("parenthesized_expression", "binary_expression")
        row = tree.add(parent, name, text(n), n.lineno, n.col_offset + 1, defines, uses, condition)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            tree.add(row, "identifier", n.name, n.lineno, n.col_offset + 1 + text(n).index(n.name), [n.name])
        for field, value in ast.iter_fields(n):
            if field in ("body", "orelse", "finalbody") and isinstance(value, list):
                if field == "orelse" and len(value) == 1 and isinstance(value[0], ast.If):
                    walk(value[0], row, n)
                else:
                    block(row, value, n)
            else:
                for child in value if isinstance(value, list) else [value]:
                    if isinstance(child, ast.AST):
                        walk(child, row, n)

    parsed = ast.parse(code)
    root = tree.add(None, "module", code, 1, 1)
    for x in parsed.body:
        walk(x, root, parsed)
    return tree.closed()


def _quiet(code: str, language: str) -> str:
    """The code with comments and the insides of strings as spaces, all line ends kept."""
    marks = {"php": r"//[^\n]*|\#[^\n]*|/\*.*?\*/", "ruby": r"\#(?!\{)[^\n]*"}.get(language, r"//[^\n]*|/\*.*?\*/")
    strings = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`[^`]*`"

    def blank(m: re.Match) -> str:
        t = m.group()
        if t[0] in "\"'`":
            return t[0] + re.sub(r"[^\n]", " ", t[1:-1]) + t[-1]
        return re.sub(r"[^\n]", " ", t)

    return re.sub(f"{strings}|{marks}", blank, code, flags=re.S)


def _goes_on(code: str, start: int, end: int) -> bool:
    """Whether the last character that is no space, from start to end, lets a statement go on."""
    while end > start and code[end - 1].isspace():
        end -= 1
    return end > start and code[end - 1] in ",+-*/=&|.("


def _statements(code: str, language: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind (open, close, plain) of the statements of quiet code."""
    start, depth = 0, 0
    for m in _SHAPING.finditer(code):
        i, c = m.start(), m.group()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth = max(0, depth - 1)
        if depth:
            continue
        if language == "ruby":
            if c in ";\n":
                part = code[start:i].strip()
                yield start, i, "close" if re.match(r"end\b", part) else "middle" if re.match(r"(?:else|elsif|rescue|when|ensure)\b", part) else "open" if _OPENS.search(part) else "plain"
                start = i + 1
        elif c == "{":
            yield start, i, "open"
            start = i + 1
        elif c == "}":
            yield start, i, "plain"
            yield i, i + 1, "close"
            start = i + 1
        elif c == ";" and language == "go" and code[start:i].lstrip().startswith("for "):
            continue
        elif c == ";" or (c == "\n" and language != "java" and not _goes_on(code, start, i)):
            yield start, i, "plain"
            start = i + 1
    yield start, len(code), "plain"


def _words(part: str, language: str) -> list[tuple[int, str]]:
    """Places and names of what can be variables in quiet code."""
    words = [(m.start(), m.group().lstrip("$@")) for m in _WORD.finditer(part) if not _CALLED.match(part, m.end())]
    return [(a, w) for a, w in words if _valid(w, language)]


def _used(part: str, language: str) -> list[str]:
    """Variables used by quiet code that defines none."""
    return sorted({w for _, w in _words(part, language)})


def _variables(part: str, kind: str, language: str) -> tuple[list[str], list[str]]:
    """Variables defined and used by one statement (quiet code)."""
    words = _words(part, language)
    defined: set[str] = set()
    m = re.search(r":=|(?<![=!<>])[-+*/.%|&]?=(?![=>])", part)
    if kind == "function_definition" or kind == "method_declaration":
        inside = re.search(r"\(([^)]*)\)", part)
        defined = {p.strip().split(" ")[0 if language == "go" else -1].lstrip("$@&*").split("=")[0] for p in inside.group(1).split(",") if p.strip()} if inside else set()
    elif m and kind in ("assignment_expression", "variable_declaration", "for_statement", "expression_statement"):
        left = part[: m.start()]
        names = [w for a, w in words if a < len(left)]
        defined = set(names if language in ("go", "ruby") or kind == "for_statement" else names[-1:] if kind == "variable_declaration" else names[:1])
    return sorted(w for w in defined if re.match(r"[A-Za-z_]", w or "")), sorted({w for a, w in words if w not in defined or (m and a > m.start())} - (defined if kind.endswith(("definition", "declaration")) and not m else set()))


def _braced(code: str, language: str) -> list[dict]:
    tree, quiet = _Tree(), _quiet(code, language)
    ends = [m.start() for m in re.finditer("\n", code)]
    root = tree.add(None, "program", code, 1, 1)
    stack = [root]

    def place(at: int) -> tuple[int, int]:
        low = bisect.bisect_left(ends, at)
        return low + 1, at - (ends[low - 1] + 1 if low else 0) + 1

    for start, end, shape in _statements(quiet, language):
        part = quiet[start:end]
        lead = len(part) - len(part.lstrip())
        part = part.strip()
        if shape == "close":
            if len(stack) > 1:
                stack.pop()
            continue
        if language == "php":
            part = re.sub(r"^<\?(?:php)?|\?>$", "", part).strip()
        if shape == "middle" and len(stack) > 1:
            stack.pop()
        if part or shape == "open":
            line, col = place(start + lead)
            kind = next((t for p, t in _STATEMENTS if p.match(part)), "block" if not part else "expression_statement")
            defined, used = _variables(part, kind, language)
            node = tree.add(stack[-1], kind, code[start:end].strip(), line, col, defined, used)
            name = re.search(r"(?:function|func|def|class|interface|module|enum)\s+(?:\([^)]*\)\s*)?(?:self\.)?(\w+)", part) or (re.search(r"(\w+)\s*\(", part) if kind == "method_declaration" else None)
            if name and kind in ("function_definition", "class_declaration", "method_declaration"):
                tree.add(node, "identifier", name.group(1), *place(start + lead + name.start(1)), [name.group(1)])
            condition = re.match(r"(?:\}?\s*else\s+)?(?:if|while|elsif|for)\s*\((.*)\)\s*$", part, re.S)
            if condition and kind in _CONDITIONED:
                a, b = start + lead + condition.start(1) - 1, start + lead + condition.end(1) + 1
                tree.add(node, "parenthesized_expression", code[a:b], *place(a), (), _used(quiet[a:b], language), True)
            if kind not in ("call_expression", "function_definition", "method_declaration", "class_declaration"):
                for c in _CALL.finditer(part):
                    if c.group().rstrip("( ").lower() not in _LOW_KEYWORDS[language]:
                        a, b = start + lead + c.start(), start + lead + len(part)
                        tree.add(node, "call", code[a:b], *place(a), (), _used(quiet[a:b], language))
            if shape in ("open", "middle"):
                stack.append(tree.add(node, "block", "", line, col) if kind != "block" else node)
    return tree.closed()


def parse(language: str, code: str) -> list[dict]:
    """Nodes of one file; one MODULE node with the error where the code cannot be parsed."""
    try:
        return _python(code) if language == "python" else _braced(code, language)
    except (SyntaxError, ValueError, RecursionError, KeyError) as e:
        return [{"id": 0, "parent_id": None, "last_id": 0, "depth": 0, "line": 1, "col": 1, "ast_type": "module", "code": code[:100], "is_condition": False, "defines": [], "uses": [], "error": f"parsing failed: {type(e).__name__}"}]


def _parsed_frames(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of many files in one frame: a frame for each costs about as much as its parsing."""
    names = [c.split()[0] for c in _ROW.split(", ")]
    for frame in frames:
        held, chars = [], 0
        for file_id, language, code in zip(frame["file_id"], frame["language"], frame["code"]):
            rows = parse(language, code or "")
            held += [{"file_id": file_id, "language": language, **r} for r in rows]
            chars += sum(len(r["code"]) for r in rows)
            if len(held) >= _HELD_ROWS or chars >= _HELD_CHARS:
                yield pd.DataFrame(held, columns=names)
                held, chars = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)


def parsed(files: DataFrame) -> DataFrame:
    """The rows of parse for every file of files (file_id, language, code)."""
    return files.select("file_id", "language", "code").mapInPandas(_parsed_frames, _ROW)


def node_table(rows: DataFrame) -> DataFrame:
    """nodes out of parsed rows: types by the ladder, MODULE for the root, names of functions, classes and calls."""
    kind = F.when(F.col("ast_type").isin("module", "program"), "MODULE").otherwise(ladders.node_type(F.col("ast_type")))
    n = rows.select("file_id", "language", "id", "parent_id", "last_id", "depth", "line", "col", "ast_type", kind.alias("node_type"), "code", "is_condition")
    named = graph.child_names(n).withColumnRenamed("name", "own")
    called = F.when(F.col("node_type") == "CALL", graph.call_name(F.col("code")))
    return n.join(named, ["file_id", "id"], "left").withColumn("name", F.coalesce("own", called)).drop("own")


def ref_table(rows: DataFrame) -> DataFrame:
    """refs out of parsed rows, lifted to all nodes above."""
    each = [rows.select("file_id", "id", F.explode(c).alias("var"), F.lit(k).alias("kind")) for c, k in (("defines", "def"), ("uses", "use"))]
    return graph.lifted(rows.select("file_id", "id", "depth"), each[0].unionByName(each[1]))


def code_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and refs of files (file_id, language, code)."""
    rows = kept(parsed(files))  # both tables are made of them
    return node_table(rows), ref_table(rows)
