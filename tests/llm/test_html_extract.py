"""HTML extraction: whole pages, awkward markup, the scan."""

import html
import itertools
import random
import re
import time

from helpers import SF

from pathlens.llm import html_extract as h
from pathlens.llm.common import table

WORDS = "some plain words that make up an ordinary sentence of an article here"
PAGES = [f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>Title {i}</h1>"
         f"<p>{WORDS}</p><p>{WORDS} again</p></article><div class='ad'>Buy this now</div><footer>&copy; all rights</footer></body></html>"
         for i in range(30)]


def weights():
    counts = h.Counter()
    for page in PAGES:
        counts.update(h.count_page(page))
    return h.weights_of(counts)


def test_supplied_pages(spark):
    pages = {r["page_id"]: r["html"] for r in table(spark, SF, "pages").collect()}
    for r in h.op10_html_extract(spark, SF).collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.S).group(1)
        blocks = [" ".join(re.findall(r"[^\x20\x09-\x0D]+", html.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", ""))))
                  for b in re.split(r"</?(?:p|h1)>", inside)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_other_layouts():
    w = weights()
    main = f"<h2>Head</h2><p>{WORDS} <a href=x>with a link</a> inside</p><div class='ad'>Buy now</div><p>{WORDS}<br>new line</p>"
    for page in (f"<body><div id=header>Site name</div><div class=menu><a>one</a></div><div class='content'>{main}</div>"
                 f"<div class=sidebar>other news</div><section id='comments'><p>{WORDS} {WORDS}</p></section></body>",
                 f"<nav>menu</nav><main>{main}<aside>note aside</aside><form><p>Your name</p></form><script>var a = '<p>no</p>'</script>"
                 "<style>p{}</style></main><footer>end</footer>"):
        assert h.main_text(page, w).split("\n") == ["Head", f"{WORDS} with a link inside", f"{WORDS} new line"]


def test_awkward_markup():
    w = weights()
    text = lambda body: h.main_text(f"<article>{body}</article>", w)
    assert text("<p>one &amp; two&nbsp;three &#233; &lt;b&gt; &amp") == "one & two\xa0three é <b> &"
    assert text("<p>un<b>bro</b>ken\n\t word</p>") == "unbroken word"
    assert text("<p>first words here<p>second words here") == "first words here\nsecond words here"
    assert text("<p>before <!-- hidden <p> --> after the comment</p>") == "before after the comment"
    assert text("<p>a title='x > y' <i title='x > y'>quoted</i> sign</p>") == "a title='x > y' quoted sign"
    assert text("<p>ends in a cut tag <a hre") .startswith("ends in a cut tag")
    assert h.main_text("", w) == "" and h.main_text("<nav><a>only</a> menu</nav>", w) == ""
    long = " ".join(["word"] * 50_000)
    assert text(f"<p>{long}</p>") == long


def test_raw_text_ends_at_its_own_end_tag():
    w = weights()
    for raw in ("<script>for(i=0;i<n;i++){x+=1}</script>", "<SCRIPT type='a'>if (a<b) '<p>' </Script >", "<script>a <!-- b</script>", "<script/><script>a<b</script\n>",
                "<style>a<b {}</style>", "<textarea>a <b' </textarea>", "<noscript><img src='x></noscript>", "<title>x <y</title>", "<iframe><!-- </iframe>",
                "<script><!-- write('<script>x</script>') --></script>", "<script><!--> a<b </script>", "<template><script>'</template>' a<b</script>no</template>",
                "<svg><title/><path d='a'/></svg>", "<script></scripts> a<b </script>"):
        for around in ("<article><p>{0}</p>{1}<p>{0}</p></article>", "<html><head>{1}</head><body><article><p>{0}</p><p>{0}</p></article></body></html>"):
            assert h.main_text(around.format(WORDS, raw), w) == f"{WORDS}\n{WORDS}", raw
    assert h.main_text(f"<article><p>{WORDS}</p></article><script>a<b", w) == WORDS


def test_head_without_end_tag():
    w = weights()
    head = "<!doctype html><html><head><meta charset=utf-8><title>not <this</title><link rel=x><script>a<b '<body>'</script><style>p{}</style><template><p>no</p></template>"
    for page in (f"{head}<body><article><p>{WORDS}</p></article></body></html>", f"{head}<article><p>{WORDS}</p></article>", f"{head}</head><article><p>{WORDS}</p></article>",
                 f"{head}</body><article><p>{WORDS}</p></article>", f"{head}</p><p>{WORDS}</p>", f"{head}{WORDS}", f"{head}<textarea>a<b</textarea>{WORDS}"):
        assert h.main_text(page, w) == WORDS, page


def test_scan_finds_the_best_range():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randrange(-5, 6) for _ in range(rng.randrange(0, 9))]
        a, b = h.best_stretch(scores)
        best = max([sum(scores[i:j]) for i, j in itertools.combinations(range(len(scores) + 1), 2)], default=0)
        assert sum(scores[a:b]) == max(0, best)


def test_awkward_rows(spark):
    frame = spark.createDataFrame([(1, None, None, 5, "x"), (2, "u", "", 5, "x"), (None, "u", PAGES[0], None, None), (3, "u", PAGES[1], 5, "x"),
                                   (3, "u", PAGES[1], 5, "x")], "page_id bigint, url string, html string, n_chars int, feature string")
    out = h.with_main_text(frame, h.train(frame))
    assert out.columns == ["page_id", "url", "feature", "text", "n_chars"]
    got = sorted((repr(r["page_id"]), r["text"][:7]) for r in out.collect())
    assert got == [("1", ""), ("2", ""), ("3", "Title 1"), ("3", "Title 1"), ("None", "Title 0")]
    assert h.with_main_text(frame.limit(0), h.train(frame.limit(0))).count() == 0


def test_names_of_pages_and_parts_of_names_condemn_nothing(spark):
    trained = h.train(table(spark, "/root/testdata/sf0.01", "pages"))
    body = f"<h1>Head line</h1><p>{WORDS}</p><p>{WORDS} again</p>"
    for page in (f"<body class='has-sidebar'><div class=content>{body}</div></body>", f"<body class='page no-comments'><article>{body}</article></body>",
                 f"<body><main id='share-article'>{body}</main></body>", f"<body><article class='post category-social-media'>{body}</article></body>",
                 f"<body><div class='widget'><main>{body}</main></div></body>", f"<div class='with-sidebar'><section class='related-work'>{body}</section></div>",
                 f"<article><header><h1>Head line</h1></header><p>{WORDS}</p><p>{WORDS} again</p></article><footer>no</footer>"):
        for w in (weights(), trained):
            assert h.main_text(page, w) == f"Head line\n{WORDS}\n{WORDS} again", page


def test_ends_of_articles_are_kept_and_notices_in_them_left_out(spark):
    trained = h.train(table(spark, "/root/testdata/sf0.01", "pages"))
    for tail, want in (("<ul><li>one</li><li>two</li></ul>", "one\ntwo"), ("<table><tr><td>cell</td><td>other</td></tr></table>", "cell\nother"),
                       ("<ol><li>only</ol>", "only"), ("<blockquote>quoted words</blockquote>", "quoted words")):
        page = f"<nav><ul><li><a>menu</a></li></ul></nav><article><p>{WORDS}</p>{tail}</article><div class=ad>Buy</div><footer>end of page</footer>"
        for w in (weights(), trained):
            assert h.main_text(page, w) == f"{WORDS}\n{want}", tail
    for inner in ("<p class=notice>We use cookies here</p>", "<span class='advert'>Buy now</span>", "<div class='site-newsletter'>Sign up</div>",
                  "<aside>by the way</aside>", "<footer>written by someone</footer>", "<section id=comments><article><p>I think so</p></article></section>"):
        page = f"<article><p>{WORDS}</p>{inner}<p>{WORDS}</p></article>"
        for w in (weights(), trained):
            assert h.main_text(page, w) == f"{WORDS}\n{WORDS}", inner


def test_a_megabyte_of_open_tags_takes_linear_time():
    w = weights()
    for part in ("<div><p>word</p>", "<b>x ", "<ul><li>x", "<i><div><b></i>y ", "<table><td>z</p></i>"):
        page = part * (1_000_000 // len(part))
        began = time.time()
        assert isinstance(h.main_text(page, w), str)
        assert time.time() - began < 10, part
