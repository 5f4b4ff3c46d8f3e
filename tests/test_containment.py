"""The containment join of evidence and lines against a plain search of every line."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from siltstone.operators import containment as J1
from siltstone.operators import findings as J

ROWS = "item string, evidence string"
TEXTS = "k long, text string"


def plain(evidence, texts):
    """For each row of evidence and each key the first line, as a set."""
    out = {}
    for item, e in evidence:
        if e is None or len(e) <= 5 or "\n" in e:
            continue
        for k, text in texts:
            for number, line in enumerate(re.split("\r?\n", text) if text is not None else [], 1):
                if e.lower() in line:
                    out[item, e, k] = min(out.get((item, e, k), number), number)
                    break
    return {(*x, n) for x, n in out.items()}


def held(spark, evidence, texts, parts=5):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(parts)
    rows = J1.evidence_lines(frame(evidence, ROWS), frame(texts, TEXTS), "k").collect()
    assert len(rows) == len({(x.item, x.evidence, x.k) for x in rows})
    return {(x.item, x.evidence, x.k, x.line) for x in rows}


def test_against_plain_search(spark):
    r = random.Random(1)
    words = [w + x for w in ("alpha", "né", "你好", "z", "#", "Tab\t") for x in ("one", "-", "ç", "")]
    line = lambda n: " ".join(r.choice(words) for _ in range(n)).lower()
    texts = [(i, r.choice(["\n", "\r\n"]).join(line(r.randrange(0, 300)) for _ in range(r.randrange(1, 6)))) for i in range(60)]
    evidence = []
    for j in range(120):
        t = r.choice(texts)[1]
        a = r.randrange(len(t) + 1)
        evidence.append((f"e{j}", t[a : a + r.choice([3, 6, 7, 20, 60, 300, 700])].upper() if j % 3 else t[a : a + r.choice([6, 12, 400])]))
    evidence += [("none", "nowhere to be found"), ("short", "abcde"), ("null", None), ("end", texts[0][1][:8] + "\n" + "x")]
    wanted = plain(evidence, texts)
    assert len(wanted) > 100 and any(len(e) > 2 * J1.REACH for _, e, _, _ in wanted)
    assert held(spark, evidence, texts) == wanted == held(spark, evidence, texts, 1)


def test_edges(spark):
    """Line ends, one-line and repeated texts, repeated evidence and keys, null keys, matches at both ends of a text and of the bytes carried along."""
    reach = J1.REACH
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(400))
    texts = [(1, "carriage\r\nreturn"), (2, "carriage\rreturn"), (2, "zz\ncarriage\rreturn"), (None, "carriage"), (3, None), (4, ""), (5, long), (6, "x\n" + long[3:]), (7, "aaaaaaaaaaaa"), (7, "\naaaaaaaaaaaa"), (8, "carriag")]
    evidence = [("a", "carriage"), ("b", "carriage\r"), ("c", "carriage\rret"), ("a", "carriage"), ("d", "aaaaaaaaaaaa"), ("e", "aaaaaaaaaaaaa"), ("f", long), ("g", long[3:])]
    evidence += [(f"h{n}", long[3 : 3 + n]) for n in (6, reach - 1, reach, reach + 5, reach + 6, reach + 7, reach + 8, 2 * reach + 6, 2 * reach + 7)]
    evidence += [(f"i{n}", long[-n:]) for n in (6, reach, reach + 6, reach + 7, 2 * reach + 7)]
    wanted = plain(evidence, texts)
    assert {("b", "carriage\r", 2, 1), ("c", "carriage\rret", 2, 1), ("a", "carriage", None, 1), ("d", "aaaaaaaaaaaa", 7, 1)} <= wanted
    assert held(spark, evidence, texts) == wanted
    assert held(spark, [], texts) == held(spark, evidence, []) == set()


def test_a_frequent_gram_is_dealt_over_tasks(spark):
    """Half of all rows hold one passage: it is found in each, and no task of the join gets all of its places."""
    texts = [(i, f"{i} the frequent passage {i}" if i % 2 else f"rare{i:06d} text") for i in range(4000)]
    evidence = [("often", "frequent passage"), ("once", "rare000122 text")]
    found = held(spark, evidence, texts)
    assert found == {("often", "frequent passage", i, 1) for i in range(1, 4000, 2)} | {("once", "rare000122 text", 122, 1)}
    rows = spark.createDataFrame([(i, i) for i in range(4000)], "fp long, pos int").select(F.pmod(F.hash("fp", "pos"), F.lit(J1.SALTS)).alias("salt"))
    assert max(Counter(x.salt for x in rows.collect()).values()) < 4 * 4000 / J1.SALTS


def test_texts_are_normalised_as_for_one_finding(spark):
    """The join agrees with the places of single findings."""
    content = 'const a = "x";\n<b>It\'s</b> &amp; more &lt;\nEXPORT const'
    evidence = ["CONST A = ", "it&#39;s</b>", "& more <", "export const", "&quot;x&quot;"]
    one = spark.createDataFrame([(1, content)], "k long, content string")
    lines = J.source_lines(F.col("content"))
    wanted = one.select(*[J.evidence_line(F.array(F.lit(e)), lines).alias(str(i)) for i, e in enumerate(evidence)]).first()
    rows = spark.createDataFrame([(str(i), e) for i, e in enumerate(evidence)], ROWS)
    found = {x.item: x.line for x in J1.evidence_lines(rows, one.select("k", J.plain_text(F.col("content")).alias("text")), "k").collect()}
    assert found == {str(i): x for i, x in enumerate(wanted) if x is not None} and len(found) >= 4
