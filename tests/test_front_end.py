"""Parser, taint over code, whole reviews, readers and the model store."""

import pytest
from pyspark.sql import functions as F

from codelode.functions import dims, ladders
from codelode.operators import flows, graph, model_store
from codelode.plans import review, style
from codelode.sources import parser, readers

PYTHON = "import os\n\ndef run(name):\n    cmd = input()\n    if cmd == 'é':\n        return cmd\n    else:\n        x = 1\n    os.system(cmd)\n"
CODES = {
    "javascript": "function f(n) {\n  // var x\n  let a = req.query.id;\n  if (a == 'b') {\n    document.write('<b>' + a);\n  } else {\n    a = g(n);\n  }\n  return a;\n}\n",
    "ruby": "def go(x)\n  y = params[:id]\n  if y\n    system(y)\n  else\n    puts y\n  end\nend\n",
    "go": 'func main(a string) {\n  x := os.Getenv("A")\n  for i := 0; i < 3; i++ {\n    exec(x)\n  }\n}\n',
    "php": '<?php\n$x = $_GET["a"];\necho $x;\nfunction f($a) { return $a; }\n?>',
    "java": 'public class A {\n  public void go(String s) {\n    String q = request.getParameter("a");\n    stmt.execute("select" + q);\n  }\n}\n',
}


def assert_nested(rows):
    """A node's interval is that of the nodes below it, by their parents."""
    under = {r["id"]: {r["id"]} for r in rows}
    for r in reversed(rows):
        if r["parent_id"] is not None:
            under[r["parent_id"]] |= under[r["id"]]
    assert all(under[r["id"]] == set(range(r["id"], r["last_id"] + 1)) for r in rows)


def types(rows):
    return [r["ast_type"] for r in rows]


def test_python_nodes_are_in_preorder_and_know_their_ancestors():
    rows = parser.parse("python", PYTHON)
    assert [r["id"] for r in rows] == list(range(len(rows)))
    for r in rows[1:]:
        assert r["depth"] == rows[r["parent_id"]]["depth"] + 1 and r["parent_id"] < r["id"]
    assert_nested(rows)
    by = {t: [r for r in rows if r["ast_type"] == t] for t in types(rows)}
    assert by["call"][0]["code"] == "input()" and by["return_statement"][0]["code"] == "return cmd" and by["return_statement"][0]["line"] == 6
    assert [r["code"] for r in by["block"]][1:] == ["return cmd", "x = 1"] and by["binary_expression"][0]["is_condition"]
    assert {v for r in rows for v in r["defines"]} == {"run", "name", "cmd", "x"}


@pytest.mark.parametrize("language", sorted(CODES))
def test_other_languages(language):
    rows = parser.parse(language, CODES[language])
    for r in rows[1:]:
        assert r["depth"] == rows[r["parent_id"]]["depth"] + 1
        assert r["code"] in CODES[language] and CODES[language].split("\n")[r["line"] - 1][r["col"] - 1 :].startswith(r["code"].split("\n")[0][:1])
    assert_nested(rows)
    defined, used = ({v for r in rows for v in r[k]} for k in ("defines", "uses"))
    want = {
        "javascript": ({"f", "n", "a"}, {"req", "a", "n", "document"}), "ruby": ({"go", "x", "y"}, {"params", "id", "y"}), "go": ({"main", "a", "x", "i"}, {"os", "x", "i"}),
        "php": ({"x", "f", "a"}, {"_GET", "x", "a"}), "java": ({"A", "go", "s", "q"}, {"request", "q", "stmt"}),
    }[language]
    assert defined == want[0] and used - {"A"} == want[1]
    assert {"function_definition", "method_declaration"} & set(types(rows))


def test_what_cannot_be_parsed_is_one_module(spark):
    files = spark.createDataFrame([(1, "python", "def ("), (2, "python", ""), (3, "javascript", "} } {"), (4, "ruby", None)], "file_id long, language string, code string")
    rows = {r["file_id"]: r for r in parser.parsed(files).filter("id = 0").collect()}
    assert rows[1]["error"].startswith("parsing failed") and rows[2]["error"] is None and len(rows) == 4
    nodes, refs = parser.code_graph(files)
    assert nodes.filter("file_id = 1 and node_type = 'MODULE'").count() == 1 and graph.edges(nodes, refs).filter("file_id = 1").count() == 0


def test_graph_of_code(spark):
    code = "def f(a):\n    if a > 1:\n        return a\n    b = a\n    return b\n\ndef g(c):\n    d = f(c)\n    while d > 1:\n        d = d - 1\n    return d\n"
    nodes, refs = parser.code_graph(spark.createDataFrame([(1, "python", code)], "file_id long, language string, code string"))
    nodes = nodes.cache()
    n = {r["id"]: r for r in nodes.collect()}
    named = {r["name"]: r["id"] for r in n.values() if r["node_type"] == "FUNCTION_DEF"}
    assert named.keys() == {"f", "g"}
    calls = graph.call_edges(nodes).collect()
    assert [(n[r["src"]]["code"], r["dst"]) for r in calls] == [("f(c)", named["f"])]
    inside = {r["id"]: r["function"] for r in graph.with_function(nodes).collect()}
    assert all(inside[i] in (named["f"], named["g"], None) for i in inside) and inside[0] is None
    control = {(n[r["src"]]["node_type"], n[r["dst"]]["code"]) for r in graph.control_edges(nodes).collect()}
    assert ("IF_STATEMENT", "return a") in control and ("WHILE_STATEMENT", "d = d - 1") in control and ("WHILE_STATEMENT", "d > 1") not in control
    data = {(n[r["src"]]["line"], n[r["dst"]]["line"]) for r in graph.data_edges(nodes, refs).collect()}
    assert (8, 9) in data and (4, 5) in data


def test_terminators_of_other_functions_do_not_count(spark):
    rows = [(0, None, [], 1, "FUNCTION_DEF"), (1, 0, [0], 2, "IF_STATEMENT"), (2, 1, [0, 1], 3, "FUNCTION_DEF"), (3, 2, [0, 1, 2], 4, "RETURN"), (4, 1, [0, 1], 6, "CALL"), (5, 0, [0], 7, "IF_STATEMENT"), (6, 5, [0, 5], 8, "RETURN"), (7, 5, [0, 5], 9, "CALL")]
    nodes = spark.createDataFrame([(1, i, p, max([i, *(k for k, _, q, _, _ in rows if i in q)]), len(path), line, 0, t, f"n{i}", "c", "python", False) for i, p, path, line, t in rows], "file_id long, id long, parent_id long, last_id long, depth int, line long, col long, node_type string, name string, code string, language string, is_condition boolean")
    assert {(r["src"], r["dst"]) for r in graph.control_edges(nodes).collect()} == {(1, 2), (1, 4), (5, 6)}


def test_taint_over_code(spark):
    rows = [(0, "ASSIGNMENT", "x = 1"), (1, "CALL", "x = input()"), (2, "ASSIGNMENT", "y = x"), (3, "ASSIGNMENT", "z = html.escape(y)"), (4, "CALL", "os.system(y)"), (5, "CALL", "os.system(z)"), (6, "CALL", "sys")]
    refs = [(0, "x", "def"), (1, "x", "def"), (2, "y", "def"), (2, "x", "use"), (3, "z", "def"), (3, "y", "use"), (4, "y", "use"), (5, "z", "use"), (6, "y", "use")]
    nodes = spark.createDataFrame([(1, i, None, i, 0, i + 1, 0, t, "n", c, "python", False) for i, t, c in rows], "file_id long, id long, parent_id long, last_id long, depth int, line long, col long, node_type string, name string, code string, language string, is_condition boolean")
    refs = spark.createDataFrame([(1, *r) for r in refs], "file_id long, id long, var string, kind string")
    issues = graph.taint_issues(nodes, refs).collect()
    assert [(r["line"], r["code"], r["type"], r["used"], r["tainted"]) for r in issues] == [(5, "os.system(y)", "command_injection", ["y"], True)]


def test_intended_seeds_over_parsed_code(spark):
    """What is assigned from a source is tainted by intent; as coded a call that defines nothing seeds nothing."""
    files = [(1, "python", "import os\nname = input()\nos.system(name)\n"), (2, "php", "<?php\n$x = $_GET['a'];\necho $x;\n?>"), (3, "javascript", "let a = req.query.id;\ndocument.write(a);\n"), (4, "python", "name = 1\nos.system(name)\n")]
    nodes, refs = parser.code_graph(spark.createDataFrame(files, "file_id long, language string, code string"))
    assert graph.taint_issues(nodes, refs).count() == 0
    assert {(r["file_id"], r["type"]) for r in graph.taint_issues(nodes, refs, intent=True).collect()} == {(1, "command_injection"), (2, "xss"), (3, "xss")}


def test_full_reviews(spark):
    files = readers.samples(spark).withColumn("file_id", F.monotonically_increasing_id())
    rows = {r["filename"]: r for r in review.full_reviews(files).collect()}
    assert rows["notes.txt"]["overall_status"] == "UNSUPPORTED_LANGUAGE" and rows["notes.txt"]["final_decision"] == "REJECT" and rows["notes.txt"]["overall_score"] == 0
    assert rows["clean.py"]["final_decision"] == "APPROVE" and rows["shell.py"]["final_decision"] == "REJECT" and rows["clean.py"]["security_score"] == 100
    assert rows["shell.py"]["recommendations"] and rows["notes.txt"]["recommendations"][0].startswith("Language detection failed:")


def test_style_results_of_odd_files(spark):
    files = spark.createDataFrame([(1, "a.py", None), (2, "a.py", " \n"), (3, "a.py", "ab"), (4, "a", "plain words only here"), (5, "a", "#!/bin/sh\necho hello"), (6, "a.py", "x = 1\n")], "file_id long, filename string, code string")
    got = {r["file_id"]: (r["status"], r["passed"], r["score"], [e["message"] for e in r["errors"] + r["warnings"]]) for r in style.style_results(files).collect()}
    assert got[1] == got[2] == ("ERROR", False, 0, [style.NO_CODE]) and got[3][3] == [style.TOO_SHORT] and got[4][3] == [style.UNDETECTED]
    assert got[5][:3] == ("WARNING", True, 80) and 'Language "shell"' in got[5][3][0] and got[6] == ("SUCCESS", True, 100, [])
    assert style.exported(style.style_results(files.limit(0))).count() == 0


def test_readers_of_changes(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    files = readers.read_file(spark, str(tmp_path / "a.py"))
    assert files.first()["code"] == "x = 1\n"
    with pytest.raises(FileNotFoundError):
        readers.read_file(spark, str(tmp_path / "b.py"))
    assert readers.changed_names(str(tmp_path)) == []
    names = spark.createDataFrame([("a.py",), ("a.py",), ("a.md",)], "filename string")
    assert readers.changed_files(files, names).count() == 1 and set(readers.tools_available()) == {"bandit", "eslint", "go"}


#: Flows with the class they are known to have.
FLOWS = [
    ("request.getParameter", "Statement.executeQuery", "none", 1), ("input()", "os.system", "none", 1), ("document.location.href", "element.innerHTML", "none", 1),
    ("sys.argv", "subprocess.run", "shlex.quote", 0), ("$_POST", "mysqli_prepare", "bind_param", 0), ("readline", "secure_function", "sanitized", 0),
]


def test_model_store_and_known_flows(spark, tmp_path):
    labels = spark.range(48).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("label"))
    model = flows.fitted_classifier(flows.training_texts(labels).select("text", "label"))
    path = str(tmp_path / "m")
    assert model_store.status(spark, path) == "MODEL_MISSING"
    with pytest.raises(model_store.ModelLoadError):
        model_store.loaded(spark, path)
    model_store.saved(model, spark, path, {"f1": 1.0})
    assert model_store.status(spark, path) == "MODEL_LOADED" and model_store.status(spark, path, 7) == "ARCHITECTURE_MISMATCH"
    assert model_store.exported(spark, path, str(tmp_path / "n")) and model_store.model_info(spark, path).first()["loaded"]
    asked = spark.createDataFrame(FLOWS, "source string, sink string, sanitization string, want int")
    rows = flows.predicted(asked, model_store.loaded(spark, path), normalize=False).collect()
    assert all(r["predicted_class"] == r["want"] and abs(r["vulnerability_score"] + r["safe_score"] - 1) < 1e-9 for r in rows)
    assert flows.rule_predictions(asked).filter("vulnerable != (want = 1)").count() == 0


def test_small_expressions(spark):
    one = spark.range(1)
    assert one.select(ladders.title(F.lit("lines_of_code"))).first()[0] == "Lines Of Code"
    assert one.select(ladders.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]
    assert len(dims.ALL_NODE_TYPES) == 24 and len(set(dims.ALL_NODE_TYPES)) == 24


def test_encodings_and_the_best_fit(spark):
    from codelode.operators import training

    texts = spark.createDataFrame([(1, "The cat, the DOG"), (2, None), (3, "dog " * 300), (3, "cat unseen"), (4, "")], "id long, text string")
    known = training.vocabulary(texts.filter("id < 4"), 8)
    words = {r["token"]: r["id"] for r in known.collect()}
    assert words == {"dog": 4, "cat": 5, "the": 6, ",": 7}
    rows = [(r["id"], r["input_ids"], r["attention_mask"]) for r in training.encoded(texts, known, 8).collect()]
    assert sorted(rows) == sorted([(1, [2, 6, 5, 7, 6, 4, 3, 0], [1] * 7 + [0]), (2, [2, 3] + [0] * 6, [1, 1] + [0] * 6), (3, [2] + [4] * 6 + [3], [1] * 8), (3, [2, 5, 1, 3, 0, 0, 0, 0], [1] * 4 + [0] * 4), (4, [2, 3] + [0] * 6, [1, 1] + [0] * 6)])
    made = spark.createDataFrame([(f"word{i % 6} thing", float((i % 6 < 2) != (i % 11 == 0)), i) for i in range(300)], "text string, label double, i long")
    model, best, every = training.best_fit(made.filter("i < 200"), made.filter("i >= 200"))
    said = model.transform(made.filter("i >= 200")).collect()
    tp = sum(r["label"] == 1 and r["prediction"] == 1 for r in said)
    wrong = sum(r["label"] != r["prediction"] for r in said)
    assert best["f1"] == max(e["f1"] for e in every) == round(2 * tp / (2 * tp + wrong), 6) and min(e["f1"] for e in every) < best["f1"] < 1
