import math
import random
from html.parser import HTMLParser

from palisade.llm.html_text import extract_text, main_text

ARTICLE = "<h1>A &amp; B</h1><p>First  paragraph with <b>bo</b>ld&nbsp;text and <a href='/x'>a link</a>.</p><ul><li>one<li>two</ul><p>Second &#233; paragraph, long enough to be read as text.</p>"
TEXT = "A & B First paragraph with bold text and a link. one two Second é paragraph, long enough to be read as text."
AROUND = "<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class='ad'>Buy now, buy cheap, a long line of advert text.</div>"
AFTER = "<aside><p>See also this long text beside the article.</p></aside><div id='comments'><p>What a fine article this is, I think.</p></div><form><label>Mail</label><input value=x><button>Send</button></form><footer>&copy; us</footer>"


def test_articles():
    for wrap in ("<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>", "<div><div>{}</div></div>"):
        page = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>" + AROUND + wrap.replace("{}", ARTICLE) + AFTER + "<script>if (a<b) x('<p>no</p>')</script></body></html>"
        assert main_text(page) == TEXT, wrap


def test_broken_pages():
    assert main_text("<p>a<p>b<script>if(a<b)</script>c") == "a b c"
    assert main_text("<body><article><p><b>cut<br>off") == "cut off"
    assert main_text("plain text only &lt;x&gt;") == "plain text only <x>"
    assert main_text("<body><!-- <p>hidden</p> --><p>seen</p><p hidden>not</p>") == "seen"
    assert main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert main_text("<nav>only a menu</nav>") == ""
    assert main_text("<p>5 < 6 and 7 > 3</p>") == "5 < 6 and 7 > 3"


def test_names_of_classes():
    assert main_text("<body><div class='nav-bar'>menu</div><article><div class='entry-header'><h1>Title</h1></div><p>Text here.</p><div class='post-comments'>x</div></article>") == "Title Text here."
    assert main_text("<body><div class='widget'><p>All of the text.</p></div>") == "All of the text."


def test_table(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>x</p>"), (3, "u", "<p>x</p>"), (None, "v", "<article>" + "<p>long text. </p>" * 5000 + "</article>")]
    from pyspark.sql import functions as F

    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 0), (2, 0), (3, 1), (3, 1), (None, 5000 * 11 - 1)]
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_attributes_are_read_by_name():
    page = '<article><p title="The hidden truth">One long text.</p><p data-hidden="false">Two here.</p><p data-id="menu">Three.</p><div class="related-work"><p>Four here.</p></div><p id="notice">Five.</p><div class="x post-comments"><p>no</p></div><div hidden><p>no</p></div></article>'
    assert main_text(page) == "One long text. Two here. Three. Four here. Five."


def test_dropped_elements_stay_dropped_at_any_depth():
    page = "<div>" * 600 + "<p>text here</p><nav>menu <b>x</b></nav><aside>side</aside><form><p>no</p></form><p>more</p>" + "</div>" * 600
    assert main_text(page) == "text here more"
    assert main_text("<div>" * 50000 + "x" + "</b>" * 50000) == "x"


class Tree(HTMLParser):
    """A page as nested lists [tag, children]; a child is such a list or a text."""

    def __init__(self, page):
        super().__init__()
        self.open = [["#page", []]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1][1].append([tag, []])
        self.open.append(self.open[-1][1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def slow_text(page):
    """The operator's definition by recursion over small, well-formed pages."""
    dropped = {"nav", "aside", "footer", "form", "script"}
    of = lambda n: [c for c in n[1] if not isinstance(c, str) and c[0] not in dropped]
    chars = lambda n: sum(len("".join(c.split())) for c in n[1] if isinstance(c, str)) + sum(map(chars, of(n)))
    tags = lambda n: sum(1 + tags(c) for c in of(n))
    link_chars = lambda n: sum(chars(c) if c[0] == "a" else link_chars(c) for c in of(n))
    link_tags = lambda n: sum((c[0] == "a") + link_tags(c) for c in of(n))
    body = Tree(page).open[0][1][0][1][0]

    def density(n):
        c, t, lc, lt = chars(n), max(tags(n), 1), link_chars(n), link_tags(n)
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + link_chars(body) / max(chars(body), 1) * c + math.e)
        return c / t * math.log(c / max(lc, 1) * t / max(lt, 1) + 1e-9) / math.log(base) if base > 1 + 1e-9 else c / t

    paths = []

    def walk(n, path):
        path = [*path, n]
        paths.append((sum(map(density, of(n))) if chars(n) else -1.0, path))
        for c in of(n):
            walk(c, path)

    walk(body, [])
    _, path = max(paths, key=lambda x: x[0])
    least, chosen = min(map(density, path)), path[-1]
    for below, above in zip(path[::-1], path[-2::-1], strict=False):
        if not all(c is below or not chars(c) or density(c) >= least or c[0] in ("h1", "p") for c in of(above)):
            break
        chosen = above
    blocks, now = [], []

    def say(n):
        for c in n[1]:
            if isinstance(c, str):
                now.append(c)
            elif c[0] in dropped:
                blocks.append("".join(now))
                now.clear()
            else:
                if c[0] not in ("a", "b"):
                    blocks.append("".join(now))
                    now.clear()
                say(c)
                if c[0] not in ("a", "b"):
                    blocks.append("".join(now))
                    now.clear()

    say(chosen)
    return " ".join(x for x in (" ".join(b.split()) for b in [*blocks, "".join(now)]) if x)


def test_random_pages_equal_a_slow_second_version():
    rng = random.Random(8)

    def some(depth):
        kind = rng.choice(["p", "p", "div", "div", "section", "nav", "aside", "a", "b", "h1", "text"]) if depth < 5 else "text"
        words = " ".join(f"w{rng.randrange(999)}" for _ in range(rng.choice((1, 3, 12, 40))))
        if kind in ("p", "h1", "a", "b"):
            inner = words + (f" <a>{words[:9]}</a> " if kind in ("p", "h1") and rng.random() < 0.3 else "")
            return f"<{kind}>{inner}</{kind}>"
        return f" {words} " if kind == "text" else f"<{kind}>" + "".join(some(depth + 1) for _ in range(rng.randrange(5))) + f"</{kind}>"

    texts = set()
    for _ in range(400):
        page = "<html><body>" + "".join(some(0) for _ in range(rng.randrange(1, 6))) + "</body></html>"
        assert main_text(page) == slow_text(page), page
        texts.add(main_text(page))
    assert len(texts) > 200
