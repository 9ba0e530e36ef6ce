import random

from pyspark.sql import functions as F

from rimefield.llm import htmltext as ht


def text(source):
    return ht.main_text(ht.parse(source))


def test_article_and_rules():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">x</a></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><h1>A &amp; B</h1><p><b>one
      two.<br><p>three &lt;x&gt; &quot;q&quot;</p><aside>no</aside><div class="share-buttons">no</div><form>no</form>
      <ul><li>first<li>second</ul><section id="comments"><article>reader</article></section></article><footer>no</footer>"""
    assert text(page) == 'A & B\none two.\nthree <x> "q"\nfirst\nsecond'


def test_odd_markup():
    assert text("") == "" and text("plain") == "plain"
    assert text("a < b <p>c</p") == "a < b\nc"
    assert text("<p>one</b> two</i></p></div>three") == "one two\nthree"
    assert text("<article><p>x<span title='>'>y</span></article>") == "xy"
    assert text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<script>never closed <p>x") == ""
    assert len(text("<article>" + "<p>word</p>" * 20000)) == 5 * 20000 - 1


def test_templates_by_host(spark):
    body = "<div><div>Welcome to our place</div><div>{}</div><p>All rights</p></div>"
    rows = [(i, "http://a.example/%d" % i, body.format(f"story number {i}")) for i in range(10)]
    rows += [(20 + i, "http://b.example/%d" % i, body.format(f"tale {i}")) for i in range(2)]
    rows += [(40, None, None), (41, "", ""), (0, rows[0][1], rows[0][2])]
    passage = "<article><p>{}</p><p>A passage that all share.</p></article>"
    rows += [(50 + i, "https://C.example:80/x", passage.format(f"own {i}")) for i in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("template", F.lit(1))
    out = [(r.page_id, r.text, r.n_chars) for r in ht.extract(pages).collect()]
    assert len(out) == len(rows)
    for i, t, n in out:
        assert n == len(t)
        if i < 10:
            assert t == f"story number {i}"
        elif i < 40:
            assert t == f"Welcome to our place\ntale {i - 20}\nAll rights"
        elif i < 50:
            assert t == ""
        else:
            assert t == f"own {i - 50}\nA passage that all share."
    assert ht.extract(pages.where("false")).count() == 0


def test_prose_is_never_dropped_by_a_name():
    page = """<article><h2 id="social-effects">Social effects</h2><p>a</p><h2 id="search-methods">Methods</h2><p class="notice">b</p>
    <div id="related-work">c</div><div class="notice">no</div><div class="share-prices">d</div><ul class="share-buttons"><li>no</ul><li class="comment">e</li></article>"""
    assert text(page) == "Social effects\na\nMethods\nb\nc\nd\ne"
    assert text("<article><p>a&nbsp;&nbsp;b &#x2003; c&#32;&#9;d</p></article>") == "a\xa0\xa0b   c d"


def sites(rng):
    """(page_id, url, html, text): stories between chrome that names don't tell, with and without landmarks, copies and shared passages."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    line = lambda n: " ".join(word() for _ in range(n))
    passage = line(70)
    rows = []
    for h in range(6):
        mark = ("article", "main", "div")[h % 3]
        top, box, foot = (f"<div><ul><li><a href='/{word()}'>{line(2)}</a></li><li>{line(1)}</li></ul></div>", f"<div class='x{h}'>{line(4)} <a href='#'>{line(1)}</a></div>", f"<p>{line(9)}</p>")
        stories = []
        for i in range(40):
            story = [line(rng.randrange(1, 40)) for _ in range(rng.randrange(2, 6))]
            if i % 9 == 0:
                story.insert(1, passage)
            stories.append(stories[0] if i in (20, 21, 22, 23) else story)
            body = [f"<p>{p}</p>" for p in stories[i]]
            body.insert(rng.randrange(len(body)), box)
            rows.append((1000 * h + i, f"http://h{h}.example/{i}", f"<html><body>{top}<{mark}>{''.join(body)}</{mark}><span>{line(3)}</span>{foot}</body></html>" if mark != "div" else f"<html><body>{top}<div>{''.join(body)}</div>{foot}</body></html>", "\n".join(stories[i])))
    return rows


def test_recurring_subtrees_decide(spark):
    """Chrome without telling names goes, inside the article too; copies of an article and shared passages stay. By hand: counts of contexts."""
    rows = sites(random.Random(12))
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in ht.extract(pages).collect()}
    assert got == {r[0]: r[3] for r in rows}
    changed = sum(text(r[2]) != r[3] for r in rows)
    assert changed == len(rows)  # none is right without the templates
    assert {r.page_id: r.text for r in ht.extract(pages.union(pages.limit(50)), most=0, per_task=7).collect()} == got
    seen = {}
    for _, url, source, _ in rows:
        root = ht.parse(source)
        ht.hash_tree(root)
        for n in ht.candidates(root):
            seen.setdefault((url.split("/")[2], ht.key(n), ht.key(n) != n.digest), set()).add(n.up.context)
    distinct = {}
    for _, url, source, _ in rows:
        distinct.setdefault(url.split("/")[2], set()).add(source)
    want = {(h, k) for (h, k, prose), c in seen.items() if len(c) >= max(3, len(distinct[h]) * (0.5 if prose else 0.1))}
    assert {(r.host, k) for r in ht.templates(pages).collect() for k in r.template} == want
