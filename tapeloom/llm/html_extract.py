"""HTML extraction with site style trees.

The pages of a host are merged into one tree of element paths. Every element of the tree has a presentation
importance (the entropy of the child sequences it is seen with) and every text node a content importance (the
entropy of its texts over the pages); a branch's importance mixes its own with the mean of what lies below it.
Hosts with few pages lean on the tree of all hosts. What an element is called (nav, footer, class names such as
comments or sidebar) is one more feature of its presentation: it lowers a branch's importance by the factor NAMED, unless
the branch holds the host's main or article elements or most of the host's text. A branch goes, inside articles as
well as outside, if its importance and that of all text in it lie below KEEP. Text blocks left are joined in page order.

Trees are built by aggregation alone: pages send counts of (host, path, kind, hash), summed first inside each batch;
entropy needs only sum(c) and sum(c log c), so no host's pages ever meet in one task. Numbers of two
digits or more in names count as one, so numbered elements are one node of the tree. A page then needs its host's decisions that differ from what
the names alone say: the topmost low branches without such a name, and the branches with one that stay. They number
with the site's templates, not with its pages.

Null html or url: empty text, host ''. Repeated rows are extracted each on their own; ties cannot arise, as no row is
chosen over another. Very long pages are read whole; an empty table gives no rows. Columns of other names pass through;
`text` and `n_chars` are replaced. Truncated or unbalanced markup is read as browsers do: end tags without a start are
ignored, open elements end with the page, a > inside a quoted attribute ends nothing.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm._shared import row, stored, table
from tapeloom.llm.url_filters import host_of

KEEP, PRIOR_PAGES, DAMP, NAMED = 0.35, 30, 0.5, 0.3
TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|object|select|xmp)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+(?=>|\Z)|[^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S | re.I)
ATTR = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = BLOCK - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "head", "body", "legend", "summary", "figcaption"}
BARRIER = frozenset("article aside body div footer form header li main nav ol section table td th tr ul dl blockquote".split())
#: Element names and name parts that say "not the article".
DROP_TAGS = frozenset("aside button dialog footer form head menu nav".split())
DROP_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer form menu modal nav navbar navigation newsletter notice notices popup promo related reply replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
WORDS, DIGITS = re.compile(r"[A-Za-z]+"), re.compile(r"[0-9]{2,}")


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str]]:
    """The text blocks of a page in order: (path of elements with class, id and role, text)."""
    out: list[tuple[tuple[str, ...], str]] = []
    stack: list[tuple[str, str]] = []  # (element, label)
    text: list[str] = []

    def end() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                out.append((tuple(label for tag, label in stack if tag in BLOCK), joined))

    at, page = 0, page or ""
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            continue
        if m.group(2):
            if any(t == tag for t, _ in stack):
                if tag in BLOCK:
                    end()
                while stack.pop()[0] != tag:
                    pass
            elif tag in BLOCK:
                end()
            continue
        if tag in BLOCK:
            end()
            shut = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in shut:
                    del stack[i:]
                    break
                if stack[i][0] in BARRIER:
                    break
        if tag not in VOID and not m.group(4).endswith("/"):
            names = " ".join(f"{k.lower()}={a or b or c}" for k, a, b, c in ATTR.findall(m.group(4)) if k.lower() in ("class", "id", "role"))
            stack.append((tag, f"{tag} {names}".strip()))
    if at < len(page):
        text.append(html.unescape(page[at:]))
    end()
    return out


MAIN = ("html", "body", "main", "article")
PATHS = 100_000  # paths whose keys a worker remembers


def named(path: tuple[str, ...]) -> bool:
    """Whether the last element of a path says by name that it isn't the article."""
    tag, _, rest = path[-1].partition(" ")
    if tag in MAIN:
        return False
    if tag in DROP_TAGS or tag == "header" and not any(x.partition(" ")[0] in ("article", "main") for x in path):
        return True
    return bool(rest) and not DROP_WORDS.isdisjoint(w.lower() for w in WORDS.findall(rest))


def _key(path: tuple[str, ...]) -> int:
    return _hash(DIGITS.sub("0", "\1".join(path).lower()))


def _hash(s: str) -> int:
    raw = s.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 31 ^ zlib.adler32(raw[::-1])


def _observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (host, path, ancestors and self, kind, hash): kind 0 a child sequence of an element, 1 a text of a text node.

    named: the ancestors (and self) that have a name of boilerplate; main: those with a main or article element in them.
    chars: the length of all the texts counted.
    """
    held: dict[tuple[str, ...], tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]] = {}

    def keys(path: tuple[str, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
        if path not in held:
            if len(held) > PATHS:
                held.clear()
            ends = range(1, len(path) + 1)
            last = max((k for k in ends if path[k - 1].partition(" ")[0] in ("main", "article")), default=0)
            up = tuple(_key(path[:k]) for k in ends)
            held[path] = up, tuple(up[k - 1] for k in ends if named(path[:k])), up[:last]
        return held[path]

    for d in batches:
        n: Counter = Counter()
        chars: Counter = Counter()
        for host, page in zip(d["host"], d["html"]):
            below: dict[tuple[str, ...], list[str]] = {}
            for path, text in blocks(page):
                for k in range(1, len(path)):
                    kids = below.setdefault(path[:k], [])
                    if not kids or kids[-1] != path[k]:
                        kids.append(path[k])
                key = host, keys(path), 1, _hash(text)
                n[key] += 1
                chars[key] += len(text)
            for path, kids in below.items():
                n[host, keys(path), 0, _hash(DIGITS.sub("0", "\2".join(kids)))] += 1
        rows = [(host, up[-1] if up else 0, list(up), list(bad), list(main), kind, h, v, chars[host, (up, bad, main), kind, h]) for (host, (up, bad, main), kind, h), v in n.items()]
        yield pd.DataFrame(rows, columns=["host", "path", "up", "named", "main", "kind", "hash", "n", "chars"])


def style_tree(pages: DataFrame, prior: int = PRIOR_PAGES) -> DataFrame:
    """(host, path, parents, named, importance, most) of every element path of every host that holds text.

    A branch: DAMP parts its own presentation, the rest the mean content of the text nodes in it; a text node: its content;
    either is lowered by NAMED where its name counts against it. most: the greatest content in a branch, lowered likewise;
    a branch is noise only if nothing in it is important. named: whether its name counts; stays_named: whether it has such a name.
    """
    paths = "array<long>"
    seen = pages.select("host", "html").mapInPandas(_observe, f"host string, path long, up {paths}, named {paths}, main {paths}, kind int, hash long, n long, chars long")
    seen = stored(seen.groupBy("host", "path", "up", "named", "main", "kind", "hash").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")))

    def node(rows: DataFrame, *keys: str) -> DataFrame:
        """Entropy of what a node shows, 0 (always the same) to 1 (always new), and how often it is seen."""
        c = rows.groupBy(*keys).agg(F.sum("n").cast("double").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"), F.sum("chars").alias("chars"))
        h = F.when(F.col("m") > 1, (F.log("m") - F.col("s") / F.col("m")) / F.log("m")).otherwise(1.0)
        return c.select(*keys, "m", h.alias("h"), "chars")

    per_host = node(seen, "host", "path", "up", "named", "main", "kind")
    every = node(seen.groupBy("path", "kind", "hash").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars")), "path", "kind").select("path", "kind", F.col("h").alias("h_all"))
    weight = F.lit(float(prior))
    both = per_host.join(every, ["path", "kind"]).withColumn("imp", (F.col("m") * F.col("h") + weight * F.col("h_all")) / (F.col("m") + weight))
    both = stored(both.select("host", "path", "up", "named", "main", "kind", "m", "chars", "imp"))
    style = both.where("kind = 0").groupBy("host", "path").agg(F.max("imp").alias("style"))
    below = both.where("kind = 1").select("host", F.posexplode("up").alias("depth", "path"), "up", "named", "main", "imp", "m", "chars")
    content = below.groupBy("host", "path").agg(
        (F.sum(F.col("imp") * F.col("m")) / F.sum("m")).alias("content"), F.max("imp").alias("most"), F.sum("chars").alias("chars"),
        F.max(F.array_contains("named", F.col("path"))).alias("has_name"), F.max(F.array_contains("main", F.col("path"))).alias("holds"), F.first(F.slice("up", 1, F.col("depth"))).alias("parents"),
    )
    total = both.where("kind = 1").groupBy("host").agg(F.sum("chars").alias("total"))
    tree = content.join(style, ["host", "path"], "left").join(total, "host")
    counts = F.col("has_name") & ~F.col("holds") & (2 * F.col("chars") <= F.col("total"))
    less = F.when(counts, F.lit(NAMED)).otherwise(F.lit(1.0))
    imp = F.when(F.col("style").isNull(), F.col("content")).otherwise(F.lit(DAMP) * F.col("style") + F.lit(1 - DAMP) * F.col("content"))
    return tree.select("host", "path", "parents", "has_name", (imp * less).alias("importance"), (F.col("most") * less).alias("most"))


def exceptions(tree: DataFrame, keep: float = KEEP) -> DataFrame:
    """(host, low, high): topmost low branches without a name of boilerplate, and branches with one that aren't low."""
    low = (F.col("importance") < keep) & (F.col("most") < keep)
    t = tree.select("host", "path", "parents", "has_name", low.alias("low"))
    known = t.where("low <> has_name")
    bad = known.where("low").select("host", F.col("path").alias("above"))
    inner = known.where("low").select("host", "path", F.explode("parents").alias("above")).join(bad, ["host", "above"], "left_semi").select("host", "path").distinct()
    top = known.join(inner, ["host", "path"], "left_anti")
    pick = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("path"))))
    return top.groupBy("host").agg(pick(F.col("low")).alias("low"), pick(~F.col("low")).alias("high"))


def extract_text(page: str | None, low: frozenset[int] | set[int] = frozenset(), high: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks of a page that no low branch holds; low and high: the host's exceptions from what names say."""
    gone: dict[tuple[str, ...], bool] = {(): False}

    def noise(path: tuple[str, ...]) -> bool:
        if path not in gone:
            key = _key(path)
            gone[path] = noise(path[:-1]) or key in low or key not in high and named(path)
        return gone[path]

    return " ".join(t for p, t in blocks(page) if not noise(p))


def extract(pages: DataFrame, keep: float = KEEP) -> DataFrame:
    """pages (url, html, ...) with `text`, the main text of each page, and `n_chars`."""
    d = pages.select(row(pages, "text", "n_chars"), F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    few = stored(exceptions(style_tree(d.select("host", "html")), keep))

    @F.pandas_udf("string")
    def main_text(pages: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        sets: dict[bytes, frozenset[int]] = {b"": frozenset()}

        def of(x) -> frozenset[int]:
            raw = b"" if x is None else np.asarray(x, np.int64).tobytes()
            if raw not in sets:
                sets[raw] = frozenset(x.tolist())
            return sets[raw]

        return pd.Series([extract_text(p, of(a), of(b)) for p, a, b in zip(pages, low, high)], dtype=object)

    d = d.join(few, "host", "left").select("row", main_text("html", "low", "high").alias("text"))
    return d.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
