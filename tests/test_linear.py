"""E2 and E4 against Python's patterns on strange texts, and in linear time on hostile ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from siltstone.functions.regex import SPACES
from siltstone.operators import extract

IMPORTED = re.compile(r"\bimport\s+(?:type\s+)?(?:[\w*{},\s]+\s+from\s+)?['\"]([^'\"]+)['\"]", re.A)
FENCE = re.compile(r"```(\w*)\n?([\s\S]*?)```", re.A)
BLOCK = re.compile(r"^\s+\"([^\"]+)\"\s*$", re.A | re.M)


def strange(pick, pieces):
    return "".join(pick.choice(pieces) for _ in range(pick.randrange(0, 14)))


def test_imports_like_the_pattern(spark):
    pieces = ["import", "import ", " type ", "type", " from ", "from", "'", '"', "a", " ", "\n", "{ x, y }", "*", "-", "é", "x.y", "'m' ", "reimport "]
    texts = [strange(random.Random(i), pieces) for i in range(3000)] + ["import 'import ' 'x'", "import  from 'x'", "import   from 'x'", "import a from 'b'import c from 'd'", "import type X from 'x'", "import''", "import 'x"]
    found = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", extract._imported(F.col("t")).alias("x")).collect()
    for r in found:
        assert r.x == IMPORTED.findall(texts[r.i]), repr(texts[r.i])


def test_go_blocks_like_the_pattern(spark):
    pieces = ['"', '"a"', "\n", " ", "\t", "x", '"b c"\n', '  "d"\n', "\n\n"]
    texts = [strange(random.Random(i), pieces) for i in range(2000)]
    found = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", extract.extract_dependencies(F.col("t"), F.lit("Go")).alias("x")).collect()
    for r in found:
        expected = [x.strip() for x in BLOCK.findall(texts[r.i])]
        assert r.x == [x for i, x in enumerate(expected) if x and x not in expected[:i]], repr(texts[r.i])


def segments(text):
    out, at = [], 0
    for m in FENCE.finditer(text):
        out += [("text", text[at : m.start()], None)] if m.start() > at else []
        out.append(("code", m[2].rstrip(SPACES), m[1] or "text"))
        at = m.end()
    return out + ([("text", text[at:], None)] if at < len(text) else [])


def test_segments_like_the_pattern(spark):
    pieces = ["```", "`", "``", "py", "\n", "x = 1", " ", "\t\n", "é", "```js\n", "```\n"]
    texts = [strange(random.Random(i), pieces) for i in range(3000)] + [""]
    found = spark.createDataFrame(enumerate(texts), "i int, t string").select("i", extract.content_segments(F.col("t")).alias("x")).collect()
    for r in found:
        assert [tuple(s) for s in r.x] == segments(texts[r.i]), repr(texts[r.i])


HOSTILE = {"blanks": "import" + " " * 1_000_000, "imports": "import " * 150_000, "words": "import " + "a, " * 350_000, "froms": "import a" + " from " * 160_000, "lines": "\n" * 1_000_000, "unclosed": "```" + "x\n" * 500_000, "fences": "``` " * 250_000 + "```", "blanks inside": "```py\nx" + " " * 1_000_000 + "y\n```", "quotes": "\"' " * 300_000}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_a_megabyte_takes_no_time(spark, name):
    df = spark.createDataFrame([(HOSTILE[name],)], "t string")
    columns = [F.size(extract.extract_dependencies(F.col("t"), F.lit("Go, Java, Python"))).alias("a"), F.size(extract.content_segments(F.col("t"))).alias("b")]
    for column in columns:
        began = time.time()
        df.select(column).collect()
        assert time.time() - began < 4


def test_null_texts(spark):
    (r,) = spark.createDataFrame([(None,)], "t string").select(extract.extract_dependencies(F.col("t"), F.lit("Go")).alias("a"), extract.content_segments(F.col("t")).alias("b")).collect()
    assert (r.a, r.b) == (None, None)
