import hashlib
import random

from pyspark.sql import functions as F

from tapeloom.llm import line_dedup as ld
from tests.llm.conftest import ODD, words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def variants(seed, groups, copies, letters="abcdé fg"):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [r.choice(letters) for _ in range(r.randint(34, 60))]
        for _ in range(copies):
            s = list(base)
            for _ in range(r.randint(0, 4)):
                k, what = r.randrange(len(s)), r.random()
                if what < 0.4:
                    s[k] = r.choice("xyz")
                elif what < 0.7:
                    del s[k]
                else:
                    s.insert(k, r.choice("xyz"))
            out.append("".join(s).strip())
    return [s for s in out if len(s) >= ld.LEAST]


def classes(links, names):
    """The sets of names that links connect."""
    top = {n: n for n in names}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in links:
        top[find(a)] = find(b)
    out = {}
    for n in names:
        out.setdefault(find(n), set()).add(n)
    return {frozenset(x) for x in out.values()}


def found(spark, lines):
    name = {hashlib.md5(s.encode()).digest(): s for s in lines}
    return [(name[bytes(r.u)], name[bytes(r.v)]) for r in ld.near_links(spark.createDataFrame([(s,) for s in lines], "line string")).collect()]


def test_classes_against_all_pairs(spark):
    lines = variants(5, 20, 5)
    unique = sorted(set(lines))
    want = [(a, b) for a in unique for b in unique if a < b and distance(a, b) <= 2]
    assert classes(found(spark, lines), unique) == classes(want, unique)


def test_many_copies_of_one_line_and_a_common_segment(spark):
    """Copies that are near their original and mostly not each other, and different lines that share segments."""
    r = random.Random(11)
    base = "the original line, of which there are many copies with one edit"
    lines = [base] + [base[:k] + r.choice("XYZ") + base[k + 1 :] for k in r.sample(range(len(base)), 40)]
    stem = "these lines all begin with the same long words, and "
    lines += [stem + "".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(40)]
    lines += [x[:-1] + "Q" for x in lines[-6:]]
    want = [(a, b) for a in lines for b in lines if a < b and distance(a, b) <= 2]
    assert classes(found(spark, lines), lines) == classes(want, lines)


def test_automaton_against_distance(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("ab") for _ in range(r.randint(0, 12))), "".join(r.choice("ab") for _ in range(r.randint(0, 12)))) for _ in range(400)]
    chars = lambda c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "")).alias(f"{c}_chars")
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", chars("a"), chars("b")).cache()
    edge = F.array(*[F.lit("")] * 3)
    df = df.withColumn("a_chars", F.concat(edge, "a_chars", edge)).cache()
    for edits in (1, 2, 3):
        got = df.select("a", "b", ld.within(F.col("a_chars"), F.col("b_chars"), edits, 3).alias("w")).collect()
        assert all(x.w == (distance(x.a, x.b) <= edits) for x in got), edits


def test_first_occurrence_stays(docs_of):
    line = "a common line of more than thirty-two characters"
    near = line.replace("common", "comon")
    docs = docs_of([(1, f"{line}\nshort\n\nonly in one document, which is long enough", "a"), (2, f"{near}\nshort\n\nx", "a"), (3, f"y\n{line}\n{line}", "a"), *[(d if d is None else d + 10, t, s) for d, t, s in ODD]])
    out = {r.doc_id: r.text for r in ld.deduplicated(docs).collect()}
    assert out[1] == f"{line}\nshort\n\nonly in one document, which is long enough"
    assert out[2] == "\nx" and out[3] == "y"
    assert out[11] is None and out[12] == ""
    flags = {(r.doc_id, r.line_no): (r.kept, r.near) for r in ld.marked(docs).collect()}
    assert flags[2, 0] == (False, True) and flags[2, 1] == (False, False) and flags[3, 1] == (False, False)


def test_empty_and_native(docs_of):
    assert ld.marked(docs_of([])).count() == 0
    plan = ld.marked(docs_of([(1, words(1, 50), "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_short_lines_against_all_pairs(spark):
    r = random.Random(3)
    lines = ["Der eingeä erer.", "Der, eingeä erer.", "Heti eror anesti.", "Heti, eror anesti.", "eleven char", "eleven chars", "ten chars.", "ten chars!"]
    for n in (11, 12, 20, 29, 30, 31, 32, 33):
        base = "".join(r.choice("abcdé fg") for _ in range(n - 1)) + "e"
        lines += [base, base[:5] + "y" + base[6:], base[:3] + base[4:], "z" + base, "z" + base[:7] + "z" + base[7:]]
    allowed = lambda a, b: 2 if max(len(a), len(b)) >= 32 else 1 if min(len(a), len(b)) >= ld.SHORT else 0
    want = [(a, b) for a in lines for b in lines if a < b and distance(a, b) <= allowed(a, b)]
    got = classes(found(spark, lines), lines)
    assert got == classes(want, lines) and any({"Der eingeä erer.", "Der, eingeä erer."} <= c for c in got)


def test_cells_are_compiled(spark):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    cells = ld._cells(spark.createDataFrame([("a line of more than thirty-two characters",)], "line string"), ld.EDITS, ld.LEAST)
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    made = debug.codegenStringSeq(cells._jdf.queryExecution().executedPlan())
    sizes = [made.apply(k)._3().maxMethodCodeSize() for k in range(made.size())]
    assert sizes and max(sizes) <= 8000
