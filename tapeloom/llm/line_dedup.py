"""Line dedup: exact copies of lines, and copies with a few edits, across all documents (DataFrame functions only).

Near copies are found with a segment-partition join. A line is cut into EDITS + 1 segments; if another line is within
EDITS edits, one segment stands in it unchanged, shifted by no more than the edits allow. Each line files its own
segments and looks up, for its own and each shorter length within EDITS, just the substrings at the shifts that a
match can have. What meets is verified with a banded bit-parallel automaton: one bit for each diagonal of the band
and one word for each number of errors, advanced one character at a time.

Only segments that different lines share are kept. All lines of such a segment are first compared with its hub, the
line that meets most others: the original, where many edited copies of one line meet. Classes are then contracted,
and only lines of different classes that still share a segment are compared in pairs, those whose letter counts allow it.
So a group of near copies costs links as it grows, not pairs, and no pair that the segments bring together is left out but
those in one class already and those that can't be near.

Exact copies collapse on the map side, so a common line costs what a rare one does. In a document's lines, all but the
first occurrence (least doc_id, then line) of each class go. The edits allowed depend on the longer line: EDITS from
LEAST characters on, one below; lines under SHORT, where one edit makes another word or number, only match exactly;
blank lines are left alone.

Nulls, odd rows: a null text has no lines; rows of one doc_id are one document, equal (doc_id, line number) one
occurrence, so repeated rows and ties keep the same line; a null doc_id is the least; very long texts and lines are
segmented and compared whole; an empty table gives no rows. Only doc_id and text are read, whatever other columns are
named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import components, gated, stored, table, text_key

EDITS, LEAST, SHORT = 2, 32, 12


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of the lines that aren't blank."""
    return docs.where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where("trim(line) <> ''")


def _slots(edits: int) -> Column:
    """(edits, i, less, shift, own) of a line's segments, and of the substrings it looks up in lines as long or shorter."""
    made = [(edits, i, 0, 0, True) for i in range(edits + 1)]
    for less in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                if less or shift:  # its own segments stand for the unshifted ones of equal length
                    made.append((edits, i, less, shift, False))
    return F.array(*[F.struct(*[F.lit(x).alias(name) for name, x in zip(("edits", "i", "less", "shift", "own"), m)]) for m in made])


def _segment(length: Column, i: Column, edits: Column) -> tuple[Column, Column]:
    """(start, length) of segment i of a line: even lengths, the longer ones last."""
    n = edits + 1
    short, long = F.floor(length / n), length % n
    extra = F.greatest(long - (n - 1 - i), F.lit(0)) - F.greatest(long - (n - i), F.lit(0))
    return short * i + F.greatest(long - (n - i), F.lit(0)), short + extra


def within(padded: Column, y: Column, edits: int, pad: int = EDITS) -> Column:
    """Whether two strings are within `edits` edits: 8 bits per error count.

    y: a column of characters; padded: a column of the other's with `pad` (`edits` or more) empty strings before and
    after them, which equal no character, so the band needs no bounds. Both must be columns, not expressions, or they
    would be built again for each character.
    """
    m, n = F.size(padded) - 2 * pad, F.size(y)
    width = 2 * edits + 1

    def row(j: Column) -> Column:  # which diagonals match at character j of y
        c = F.get(y, j - 1)
        hits = [F.when(F.get(padded, j + (d - 1 + pad - edits)) == c, F.lit(1 << d)).otherwise(0) for d in range(width)]
        return reduce(lambda p, q: p + q, hits)

    def word(acc: Column, e: int) -> Column:
        return F.shiftright(acc, 8 * e).bitwiseAND(0xFF)

    def step(acc: Column, match: Column) -> Column:
        before = word(acc, 0)
        new = before.bitwiseAND(match)
        out = new
        for e in range(1, edits + 1):
            old = word(acc, e)
            new = old.bitwiseAND(match).bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new, 1)).bitwiseAND((1 << width) - 1)
            out = out + F.shiftleft(new, 8 * e)
            before = old
        return out

    start = F.lit(sum(sum(1 << (edits + i) for i in range(e + 1)) << (8 * e) for e in range(edits + 1)))
    rows = F.transform(F.sequence(F.lit(1), n), row)
    accepted = F.aggregate(rows, start, step, lambda acc: F.call_function("shiftright", word(acc, edits), (m - n + edits).cast("int")).bitwiseAND(1))
    plain = F.levenshtein(F.array_join(padded, ""), F.array_join(y, "")) <= edits
    return (F.abs(m - n) <= edits) & F.when((n > 0) & (m > edits), accepted == 1).otherwise(plain)


def letters(line: Column) -> Column:
    """How often each letter, in either case, the blank, the comma, the point and all other characters occur."""
    common = [" ", ",", ".", *(x + x.upper() for x in "abcdefghijklmnopqrstuvwxyz")]
    return F.array(*[F.length(line) - F.length(F.translate(line, c, "")) for c in common], F.length(F.translate(line, "".join(common), "")))


def may_be_near(p: Column, q: Column, edits: int) -> Column:
    """Whether letter counts allow so few edits: an edit adds at most one character that the other lacks, either way."""
    over = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0))), F.lit(0), lambda n, x: n + x)
    return (over(p, q) <= edits) & (over(q, p) <= edits)


def _cells(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """(key, h, own) of every segment that a line files (own) or looks up; h: hash of the line.

    A line is dealt out over its slots before anything is cut from it, so one small expression serves all of them:
    spelt out slot by slot, the generated method passes the 8,000 bytes up to which the JVM compiles.
    """
    n, long, short = F.col("n"), _slots(edits), _slots(min(edits, 1))
    some = n >= least - edits  # long lines, and those just shorter than a long partner
    slots = F.when(some & (n >= SHORT) & (n < least), F.concat(long, short)).when(some, long).otherwise(short)
    d = lines.select("line", F.length("line").alias("n"), F.xxhash64("line").alias("h")).where(n >= min(SHORT, least - edits))
    d = d.select("line", "n", "h", F.explode(slots).alias("s")).select("line", "n", "h", "s.*").withColumn("of", F.col("n") - F.col("less"))
    start, size = _segment(F.col("of"), F.col("i"), F.col("edits"))
    d = d.select("line", "n", "h", "edits", "of", "i", "own", (start + F.col("shift")).alias("at"), size.alias("size"))
    d = d.where((F.col("of") > F.col("edits")) & (F.col("at") >= 0) & (F.col("at") + F.col("size") <= n))
    return d.select(F.xxhash64("of", "i", F.substring("line", (F.col("at") + 1).cast("int"), F.col("size").cast("int"))).alias("key"), "h", "own")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int, least: int) -> DataFrame:
    """The pairs (u, v) of text keys that are within the edits their lengths allow."""
    few = texts.select("k", "letters")
    p = pairs.join(few.select(F.col("k").alias("u"), F.col("letters").alias("p")), "u").join(few.select(F.col("k").alias("v"), F.col("letters").alias("q")), "v")
    p = stored(p.where(may_be_near(F.col("p"), F.col("q"), edits)).select("u", "v"))
    both = p.join(texts.select(F.col("k").alias("u"), F.col("padded").alias("x")), "u").join(texts.select(F.col("k").alias("v"), F.col("chars").alias("y")), "v")
    short, long = F.least(F.size("x") - 2 * edits, F.size("y")), F.greatest(F.size("x") - 2 * edits, F.size("y"))
    near = lambda e: within(F.col("x"), F.col("y"), e, edits)
    return both.where(F.when(long >= least, near(edits)).when(short >= SHORT, near(min(edits, 1))).otherwise(False)).select("u", "v")


def near_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """Links (u, v) between text keys of different lines whose components are the classes; lines: a column `line`.

    Every link is within the edits its lines' lengths allow, or runs between two lines that such links connect.
    """
    cells = stored(_cells(lines, edits, least))
    live = cells.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.max("own").alias("own"))
    live = stored(live.where("low <> high and own").select("key"))
    met = gated(cells, "key", live).join(live, "key").groupBy("key", "h").agg(F.max("own").alias("own"))
    met = stored(met)
    # the texts of the lines that met
    ids = met.select("h").distinct()
    texts = lines.select("line").withColumn("h", F.xxhash64("line"))
    texts = gated(texts, "h", ids).join(ids, "h", "left_semi").select("h", "line").distinct()
    edge = F.array(*[F.lit("")] * edits)
    chars = F.split("line", "")
    texts = stored(texts.select("h", text_key(F.col("line")).alias("k"), chars.alias("chars"), F.concat(edge, chars, edge).alias("padded"), letters(F.col("line")).alias("letters")))
    met = stored(met.join(texts.select("h", "k"), "h").select("key", "k", "own"))
    known = texts.select("k", "letters", "chars", "padded")
    # hubs
    n = met.groupBy("key").agg(F.count("*").alias("n"))
    weight = met.join(n, "key").groupBy("k").agg(F.sum("n").alias("met"))
    hubs = met.join(weight, "k").groupBy("key").agg(F.max(F.struct("met", "k")).alias("x")).select("key", F.col("x.k").alias("hub"))
    star = stored(met.join(hubs, "key").where("k <> hub"))
    pair = lambda a, b: (F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    roots = stored(components(_verified(star.select(*pair("k", "hub")).distinct(), known, edits, least)))
    # what the hubs leave apart; a hub has met all lines of its segments
    now = star.join(roots, star.k == roots.node, "left").select("key", "k", "own", F.coalesce("root", "k").alias("root"))
    split = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("own").alias("some")).where("low <> high and some").select("key")
    now = stored(now.join(split, "key").join(texts.select("k", "letters"), "k"))
    own = now.where("own").select("key", F.col("k").alias("o"), F.col("root").alias("o_root"), F.col("letters").alias("o_letters"))
    apart = (F.col("root") != F.col("o_root")) & may_be_near(F.col("letters"), F.col("o_letters"), edits)
    rest = own.join(now.drop("own").withColumnRenamed("key", "n_key"), (F.col("key") == F.col("n_key")) & apart)
    more = _verified(rest.select(*pair("k", "o")).distinct(), known, edits, least)
    return stored(more.unionByName(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))


def marked(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, line_no, chars, kept, near) of each line: whether it stays, and whether it only nearly equals the first."""
    lines = lines_of(docs.select("doc_id", "text"))
    seen = stored(lines.select("doc_id", "line_no", text_key(F.col("line")).alias("key"), F.length("line").alias("chars")))
    roots = components(near_links(lines, edits, least)).select(F.col("node").alias("key"), "root")
    each = seen.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    each = each.join(roots, "key", "left").where("n > 1 or root is not null").withColumn("root", F.coalesce("root", "key"))
    each = stored(each)
    best = each.groupBy("root").agg(F.min("first").alias("best"))
    known = each.join(best, "root").select("key", "best", (F.col("first") != F.col("best")).alias("near"))
    out = seen.join(known, "key", "left")
    kept = F.col("best").isNull() | F.struct("doc_id", "line_no").eqNullSafe(F.col("best"))
    return out.select("doc_id", "line_no", "chars", kept.alias("kept"), (~kept & F.coalesce("near", F.lit(False))).alias("near"))


def deduplicated(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(doc_id, text) with repeated lines taken out, blank lines left where they are."""
    drop = marked(docs, edits, least).where("not kept").select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_n"))
    every = docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("line_no", "line"))
    rest = every.join(drop, every.doc_id.eqNullSafe(drop._d) & (every.line_no == drop._n), "left_anti")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    joined = rest.groupBy("doc_id").agg(F.when(F.max("line_no").isNotNull(), text).alias("text"))
    ids = docs.select(F.col("doc_id").alias("_d"), F.col("text").isNull().alias("_null")).distinct()
    out = ids.join(joined, ids._d.eqNullSafe(joined.doc_id), "left")
    return out.select(F.col("_d").alias("doc_id"), F.when(~F.col("_null"), F.coalesce("text", F.lit(""))).alias("text"))


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go as copies of earlier ones (`removed`, of them `near`), and the characters kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    per = marked(docs).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.sum((~F.col("kept")).cast("long")).alias("removed"), F.sum(F.col("near").cast("long")).alias("near"),
        F.sum(F.when(F.col("kept"), F.col("chars")).otherwise(0)).cast("long").alias("kept_chars"),
    ).withColumnRenamed("doc_id", "_id")
    ids = docs.select("doc_id")
    zero = F.lit(0).cast("long")
    return ids.join(per, ids.doc_id.eqNullSafe(per._id), "left").select("doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_lines", "removed", "near", "kept_chars")])
