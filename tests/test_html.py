"""Visible content against a tree built by the standard parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from corpusloom.functions import html as H

FURNITURE = "(?i)subscribe|cookie"


class Tree(HTMLParser):
    """Texts outside of skipped elements, for pages whose tags are all closed in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.texts, self.heads, self.own = [], [], [], None

    def skipped(self, tag, attrs):
        a = dict(attrs)
        return tag in (*H.SKIPPED, "script", "style", "iframe", "noscript") or any(m in (a.get("class") or "") for m in H.MARKED[0]) or any(m in (a.get("id") or "") for m in H.MARKED[1])

    def handle_starttag(self, tag, attrs):
        if tag not in H.VOID:
            self.open.append((tag, self.skipped(tag, attrs)))
            if tag in ("h1", "h2", "h3") and not any(s for _, s in self.open):
                self.heads.append("")

    def handle_endtag(self, tag):
        if tag not in H.VOID:
            assert self.open.pop()[0] == tag

    def handle_data(self, data):
        if any(s for _, s in self.open):
            return
        self.texts.append(data)
        tags = [t for t, _ in self.open]
        if "title" in tags:
            self.own = (self.own or "") + data
        if any(t in ("h1", "h2", "h3") for t in tags):
            self.heads[-1] += data


def expected(page, url):
    tree = Tree()
    tree.feed(page)
    tree.close()
    kept, seen = [], set()
    for text in tree.texts:
        for line in text.split("\n"):
            line = " ".join(line.replace("\xa0", " ").split())
            if len(line) >= 2 and not any(w in line.lower() for w in ("subscribe", "cookie")) and line.lower() not in seen:
                seen.add(line.lower())
                kept.append(line)
    title = " ".join((tree.own or "").split())
    if title.lower() in ("", "home"):
        heads = [" ".join(h.split()) for h in tree.heads]
        title = next((h for h in heads if len(h) >= 4 and "cookie" not in h.lower()), url.split("#")[1].rsplit("/", 1)[-1] if "#" in url else url)
    return title, kept


def page(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        if kind < 0.35 or depth > 4:
            out += rng.choice(["word one", "Word One", " two &amp; three ", "x", "line\nnext line", "a\xa0b", "cookie note", "1 &lt; 2 &#233;&#x41; &nope;", "   ", "été"])
        elif kind < 0.5:
            out += rng.choice(['<br>', '<img class="chatbot" alt="a > b">', "<!-- <nav> -->", '<script>var t = "</p><nav>";</script>', "<style>p{}</style>", "<hr/>"])
        else:
            tag = rng.choice(["div", "p", "b", "nav", "header", "section", "h1", "h2", "Div"])
            mark = rng.choice(["", "", "", ' class="big chatbot-x"', " id='pageFooter'", ' class="plain" data-x="<b>"', " CLASS=FooterContainer"])
            inner = page(rng, depth + 1)
            if tag in ("h1", "h2"):
                inner = rng.choice(["Heading of it", "ab", "cookie head"])
            out += f"<{tag}{mark}>{inner}</{tag}>"
    return out


def run(spark, rows):
    table = spark.createDataFrame(rows, "id long, url string, page string").select("id", "url", H.visible(H.pieces(F.col("page"))).alias("k"))
    return {r.id: (r.t, list(r.l)) for r in table.select("id", H.title(F.col("k"), F.col("url"), FURNITURE, ("home",)).alias("t"), H.lines(F.col("k"), FURNITURE).alias("l")).collect()}


def test_random_pages(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice(["http://a/b", "http://a/#/x/y?z=1", "http://a/#last"]).replace("?z=1", ""), rng.choice(["", "<title>Home</title>", "<title> A  page </title>"]) + page(rng)) for k in range(300)]
    got = run(spark, rows)
    for k, url, text in rows:
        assert got[k] == expected(text, url), text


def test_odd_pages(spark):
    cases = {None: [], "": [], "<nav>never closed <b>x</b>": [], "1 < 2": [], "<p>open": ["open"], "</div>stray": ["stray"], "<!-- never closed": [], "<script>x": [], "<b>" * 3000 + "deep": ["deep"], "w " * 20 + "x, " * 40_000: ["w " * 20 + "x, " * 39_999 + "x,"]}
    got = run(spark, [(k, "http://u", p) for k, p in enumerate(cases)])
    for k, (p, want) in enumerate(cases.items()):
        assert got[k][1] == want, p
