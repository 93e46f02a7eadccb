"""Text functions: known answers, plain Python versions, and texts that are missing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from simlattice.functions import answers as A
from simlattice.functions import text as T


def value(spark, expr, **row):
    schema = ", ".join(f"{k} string" for k in row) or "x string"
    return spark.createDataFrame([tuple(row.values()) or ("",)], schema).select(expr.alias("v")).first()["v"]


def normal(t):
    words = "".join(c if c.isalnum() or c in "+#." else " " for c in t.lower()).split(" ")
    return " " + " ".join(w for w in (x.rstrip(".") for x in words) if w) + " "


def test_tokens_and_shingles(spark):
    rng = random.Random(1)
    for _ in range(20):
        t = " ".join(rng.choice(["A", "b", "Cc", "d\n", " "]) for _ in range(rng.randint(0, 14)))
        w = t.lower().split()
        assert value(spark, T.tokens("t"), t=t) == w
        assert set(value(spark, T.shingles("t"), t=t)) == {" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
    assert value(spark, T.tokens("t"), t=None) == []
    assert value(spark, T.shingles("t"), t=None) == [""]


def test_normalise_and_phrases(spark):
    for t in ("Python. C++ and C#... node.js!", "", "...", "a a a", "É x"):
        assert value(spark, T.normalise("t"), t=t) == normal(t)
    assert value(spark, T.phrase_count(T.normalise("t"), F.lit("a")), t="a a a") == 2
    assert value(spark, T.phrase_count(T.normalise("t"), F.lit("python")), t="Pythonic python, Python.") == normal("Pythonic python, Python.").count(" python ")


def test_terms(spark):
    def by_hand(t):
        words = normal(t).split()
        own = {w for w in words if len(w) >= 3 and w not in T.STOPWORDS and not w.isdigit()}
        return own | {f"{a} {b}" for a, b in zip(words, words[1:]) if a in own and b in own}

    for t in ("The quick brown fox, 123 and dapper fox.", "", "of the", "one apple two pears apple pears"):
        assert set(value(spark, T.terms("t"), t=t)) == by_hand(t)


def test_chunks_and_lines(spark):
    words = [f"w{i}" for i in range(301)]
    assert value(spark, T.chunks("t"), t=" ".join(words)) == [" ".join(words[i : i + 150]) for i in (0, 150, 300)]
    assert value(spark, T.chunks("t"), t=" ") == []
    for t in ("a\nb\r\nc\rd\x0be\x0cf\x1cg\x85h i", "a\n", "\n", "", "a\n\nb"):
        assert value(spark, T.lines("t"), t=t) == t.splitlines()


def test_structure_features(spark):
    t = "# Title\n- one\n* two\n1. foo\n1.\n2..x\n12.\n```py\nx?\n```\n  ## more?\n"
    words = math.log1p(len(t.split()))
    got = value(spark, T.structure_features("t"), t=t)
    assert got == [pytest.approx(words), 2.0, 1.0, 2.0, 2.0, 2.0]


@pytest.mark.parametrize(("path", "stem"), [("a/b/Debugger.md", "debugger"), ("x.tar.gz", "x.tar"), ("dir/.hidden", ".hidden"), ("plain", "plain"), ("", "")])
def test_file_stem(spark, path, stem):
    assert value(spark, T.file_stem("p"), p=path) == stem


def test_ids_and_names(spark):
    assert value(spark, T.clean_id("s", "n"), s="a b", n="x (y): z's") == "a_b/x__y___z_s"
    assert value(spark, T.normalise(T.strip_name("t", "n")), t="The python-debug and Python debug tool", n="python-debug").split() == ["the", "and", "python", "debug", "tool"]
    assert value(spark, T.probe_hash("p", "q"), p="a", q=None) == value(spark, T.probe_hash("p", "q"), p="a", q="None")


def test_sets_and_combination(spark):
    row = spark.createDataFrame([(["A ", "a", "", "b"], ["b", "c"])], "x array<string>, y array<string>")
    assert row.select(T.clean_set("x").alias("v")).first()["v"] == ["a", "b"]
    assert set(row.select(T.mode_set("x", "y").alias("v")).first()["v"]) == {"a", "b", "c"}
    d = lambda a, b: spark.createDataFrame([(a, b)], "a array<string>, b array<string>").select(T.jaccard_distance(F.col("a"), F.col("b")).alias("v")).first()["v"]
    assert (d([], []), d([], ["x"]), d(["x"], ["x"]), d(["x", "y"], ["y", "z"])) == (0.0, 1.0, 0.0, pytest.approx(2 / 3))
    mix = lambda a, b, empty=1.0: spark.createDataFrame([(a, b)], "a double, b double").select(T.combine({"a": F.col("a"), "b": F.col("b")}, {"b": 3.0}, empty).alias("v")).first()["v"]
    assert mix(0.2, 0.4) == pytest.approx(0.35) and mix(0.2, None) == pytest.approx(0.2)
    assert (mix(None, None), mix(None, None, 0.0)) == (1.0, 0.0)


def test_lineage_labels(spark):
    label = lambda x, y: spark.createDataFrame([(x, y)], "l double, f double").select(T.classify_lineage(F.col("l"), F.col("f")).alias("v")).first()["v"]
    assert [label(0.9, 0.8), label(0.2, 0.9), label(0.2, 0.2)] == ["homologous", "convergent", "unclassified"]


def test_wilson(spark):
    w = lambda k, n: spark.createDataFrame([(k, n)], "k long, n long").select(T.wilson(F.col("k"), F.col("n")).alias("v")).first()["v"]
    assert round(w(26, 26)["low"], 3) == 0.871 and w(26, 26)["high"] == 1.0
    assert tuple(w(0, 0)) == (0.0, 1.0)


def test_unit_and_cosine(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    got = row.select(T.unit("a").alias("u"), T.unit("z").alias("z"), T.cosine_distance(T.unit("a"), T.unit("a")).alias("d"), T.cosine_distance(T.unit("a"), T.unit("z")).alias("n")).first()
    assert got["u"] == pytest.approx([0.6, 0.8]) and got["z"] is None and got["d"] == pytest.approx(0.0) and got["n"] is None


ANSWER = """text
```python
def f():
    return 1
```
~~~
assert f()
~~~
````py
open
"""


def blocks_of(spark, text):
    return [tuple(b) for b in spark.createDataFrame([(text,)], "t string").select(A.code_blocks("t").alias("b")).first()["b"]]


def test_code_blocks(spark):
    assert blocks_of(spark, ANSWER) == [("python", "def f():\n    return 1"), ("", "assert f()")]
    assert blocks_of(spark, None) == [] and blocks_of(spark, "````py\nx = 1\n````") == [("py", "x = 1")]
    assert blocks_of(spark, "  ``` Py \r\n\ta\r\n\r\n```js\n~~~~\n```\n```") == [("py", "\ta\n\n```js"), ("", "")]
    assert blocks_of(spark, "~~\n``\n```\nopen") == []


def test_extraction(spark):
    fix, test = "def f():\n    return 2", "def test_f():\n    assert f()"
    answer = f"```python\n{fix}\n```\n```python\n{test}\n```"
    code = lambda t, r=None: spark.createDataFrame([(t, r)], "t string, r string").select(A.extract_code("t", None if r is None else "r").alias("c")).first()["c"]
    assert code(answer, "def f():\n    return 1") == fix
    assert code(answer) == test and code("none") is None and code(None) is None
    assert code("```js\nx\n```", "") == "x" and code("```js\nx\n```\n```py\ny\n```\n```c\nz\n```") == "y"
    assert A.names_of("X = Y = 1\nclass C: pass\nasync def g(): pass\nx.y = 2\na, b = 1, 2\nif X:\n    Z = 1\nW: int = 1\n") == {"X", "Y", "C", "g"}
    assert A.names_of("def (") == A.names_of(None) == A.names_of("\0") == frozenset()
    names = spark.createDataFrame([("b = 1\ndef a(): pass",), (None,)], "c string").select(A.top_level_names("c").alias("n")).collect()
    assert [r["n"] for r in names] == [["a", "b"], []]
    files = {"a.py": "def a(): pass", "b.py": "def b(): pass"}
    changed = lambda t, f=files: spark.createDataFrame([(t, f)], "t string, f map<string,string>").select(A.extract_files("t", "f").alias("m")).first()["m"]
    assert changed("```python\n# file: a.py\nnew\n```\n```python\ndef b(): return 1\n```") == {"a.py": "new"}
    assert changed("```python\ndef b(): return 1\n```") == {"b.py": "def b(): return 1"}
    assert changed("```python\n# File: a.py\none\n```\n```\n# file:  a.py \ntwo\nthree\n```") == {"a.py": "two\nthree"}
    assert changed("```python\n# file: c.py\ndef a(): return 1\n```\n```python\ndef a(): return 2\n```") == {}
    assert changed("```js\ndef a(): return 1\n```") == changed(None) == changed("```\nz = 1\n```") == {}
