import random

import pytest

from tapeloom.llm import html_extract as h

PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy &amp; {n}</div><div class="c7">{junk}</div><div id="main-{k}"><article><h1>Head {n}</h1><p><b>Some &lt;bold&gt;\n text&nbsp;{n}<br>more<p>Second\t one.</p></article></div><section class="comments"><p>Nice {n}!</p></section><form><label>Mail</label></form><footer>&copy; us</footer>'


def test_blocks_and_names(spark):
    pages = [(k, f"https://h{k % 2}.org/{k}", PAGE.format(n=k, k="x", junk="Always the same box"), "t") for k in range(40)]
    pages += [(100, None, None, "t"), (101, "https://h0.org/", "", "t"), (102, "https://h9.org/", "plain text &amp", "t"), (103, "https://h1.org/", "<p>a <i>b</i>c<script>x", "t"), (0, pages[0][1], pages[0][2], "t")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, _host string")
    got = {r.page_id: (r.text, r.n_chars) for r in h.extract(df).collect()}
    for k in range(40):
        want = f"Head {k} Some <bold> text {k} more Second one."
        assert got[k] == (want, len(want))
    assert got[100] == ("", 0) and got[101] == ("", 0) and got[102][0] == "plain text &" and got[103][0] == "a bc"
    assert h.extract(df).count() == len(pages)
    assert h.extract(df.limit(0)).count() == 0


def test_style_tree_drops_what_a_site_repeats(spark):
    """No names to go by: only the repetition over the site's pages tells the box from the text."""
    page = "<body><div class='k1'><p>Same words on every page</p></div><div class='k2'><p>Body number {n} says {n}</p></div></body>"
    df = spark.createDataFrame([(k, "http://s.org/", page.format(n=k)) for k in range(60)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {k: f"Body number {k} says {k}" for k in range(60)}


@pytest.mark.parametrize(("page", "want"), [("<p>one<p>two", ["one", "two"]), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("a</div>b", ["a", "b"]), ("<table><tr><td>x<td>y</table>", ["x", "y"]), ("<p>x < y</p>", ["x < y"]), ("<!-- open", []), ("<a href='>'>k</a>", ["k"]), ("<p title='a>b</p>c", ["b", "c"]), ("<math><mi>x</mi></math>", ["x"])])
def test_markup(page, want):
    assert [t for _, t in h.blocks(page)] == want


def test_very_long_page():
    assert len(h.blocks("<p>" + "word " * 200_000)[0][1]) == 999_999


def test_style_tree_judges_inside_articles(spark):
    page = "<body><main><article><p>Body number {n} says {n}</p><div class='k7'>Read more on this site</div></article></main></body>"
    df = spark.createDataFrame([(k, "http://s.org/", page.format(n=k)) for k in range(60)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {k: f"Body number {k} says {k}" for k in range(60)}


@pytest.mark.parametrize("page", ["<body class='single has-sidebar comments-open'><p>All of {n}", "<div class='content-with-sidebar'><article class='share comments-open'><p>All of {n}</article></div>", "<body><form><div><p>All of {n}</div></form>", "<div data-id='ad-12'><p>All of {n}</div>", "<p title='a > b'>All of {n}", "<p title=\"it's\">All of <math><mi>{n}</mi></math>"])
def test_names_never_drop_the_article(spark, page):
    whole = page + "<div class='sidebar'>x {n} y</div>"
    df = spark.createDataFrame([(k, "http://s.org/", whole.format(n=k)) for k in range(40)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in h.extract(df).collect()} == {k: f"All of {k}" for k in range(40)}


def brute_force(pages, keep=h.KEEP):
    """The style tree by its definition, one host at a time, in plain Python."""
    import math
    from collections import Counter, defaultdict

    def entropy(c):
        m = sum(c.values())
        return m, (1.0 if m == 1 else -sum(v / m * math.log(v / m) for v in c.values()) / math.log(m))

    label = lambda path: tuple(h.DIGITS.sub("0", x.lower()) for x in path)
    texts, kids, every_text, every_kids = (defaultdict(Counter) for _ in range(4))
    chars, total, real = Counter(), Counter(), {}
    for host, page in pages:
        below = defaultdict(list)
        for path, text in h.blocks(page):
            for k in range(1, len(path) + 1):
                real.setdefault(label(path[:k]), path[:k])
                chars[host, label(path[:k])] += len(text)
                if k < len(path) and (not below[path[:k]] or below[path[:k]][-1] != path[k]):
                    below[path[:k]].append(path[k])
            texts[host, label(path)][text] += 1
            every_text[label(path)][text] += 1
            total[host] += len(text)
        for path, seq in below.items():
            kids[host, label(path)][label(seq)] += 1
            every_kids[label(path)][label(seq)] += 1

    def importance(own, every):
        m, e = entropy(own)
        return m, (m * e + h.PRIOR_PAGES * entropy(every)[1]) / (m + h.PRIOR_PAGES)

    def low(host, path):
        under = [(importance(c, every_text[p]), p) for (w, p), c in texts.items() if w == host and p[: len(path)] == path]
        content = sum(m * i for (m, i), _ in under) / sum(m for (m, _), _ in under)
        most = max(i for (_, i), _ in under)
        holds = any(x.split(" ")[0] in ("main", "article") for _, p in under for x in p[len(path) - 1 :])
        less = h.NAMED if h.named(real[path]) and not holds and 2 * chars[host, path] <= total[host] else 1.0
        if (host, path) in kids:
            content = h.DAMP * importance(kids[host, path], every_kids[path])[1] + (1 - h.DAMP) * content
        return content * less < keep and most * less < keep

    return [" ".join(t for p, t in h.blocks(page) if not any(low(host, label(p[:k])) for k in range(1, len(p) + 1))) for host, page in pages]


def test_against_brute_force(spark):
    r = random.Random(5)
    boxes = ["<div class='k1'>Same on all pages</div>", "<nav><a>Home</a></nav>", "<div id='c-{n}' class='comments'><p>Nice {n}</p></div>", "<aside>Ad {n}</aside>", "<div class='k3'><span>often {m}</span></div>", "<form><p>Mail</p></form>", "<div class='teaser'><h3>More {n}</h3><p>Read on</p></div>"]
    pages = []
    for k in range(120):
        inner = [x.format(n=r.randrange(1000), m=r.randrange(3)) for x in r.sample(boxes, r.randint(1, 5))]
        body = "".join(inner[: len(inner) // 2]) + f"<div id='post-{k}'><h1>Title {k}</h1><p>Text of {k} {r.random()}</p>" + "".join(inner[len(inner) // 2 :]) + "</div>"
        pages.append((f"h{r.choice([0, 0, 0, 1, 1, 2, 3])}.org", f"<html><body>{'<main>' if k % 3 else ''}{body}</body></html>"))
    df = spark.createDataFrame([(k, f"http://{host}/", page) for k, (host, page) in enumerate(pages)], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in h.extract(df).collect()}
    assert [got[k] for k in range(len(pages))] == brute_force(pages)
    plain = [h.extract_text(page) for _, page in pages]
    assert sum(a != b for a, b in zip(plain, brute_force(pages))) > 30  # the tree changes what names alone would keep


def test_columns_with_the_operators_own_names(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<p>x", "l", "h", "r")], "page_id long, url string, html string, low string, host string, row string")
    assert [tuple(r) for r in h.extract(df).collect()] == [(1, "http://a.org/", "<p>x", "l", "h", "r", "x", 1)]
