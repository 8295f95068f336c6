"""The content model on labelled pages that it wasn't trained on, with layouts of their own: the share of lines that are right."""
from maskfold.llm.html_content import main_text, train
from maskfold.llm.labelled_pages import PAGES

A = "Glass was blown in the village for four hundred years, and the furnaces were fed with beech from the slopes above it."
B = "When the last kiln closed, the workers opened a museum in the old cutting shed and taught visitors to shape a bowl."
C = "Each spring the sand is washed, dried and mixed with ash before the first melt is poured."
AD = "Save forty percent on garden furniture this weekend only, delivery is free of charge."

# (page, the lines of its article)
HELD_OUT = [
    (f"""<html><head><title>x</title><style>p{{}}</style></head><body><div class="topbar"><a href="/">Start</a> <a href="/map">Map</a></div>
      <div class="page"><div class="left"><div class="nav-box"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></div></div>
      <div class="middle"><h1>Glass village</h1><p>{A}</p><p>{B}</p><p>{C}</p></div></div><div class="footer"><p>Imprint. All rights reserved.</p></div></body></html>""",
     ["Glass village", A, B, C]),
    (f"""<body><header role="banner"><p>The Glass Times</p><nav><a href="/a">News</a><a href="/b">Arts</a></nav></header>
      <main><article itemprop="articleBody"><h1>Old kilns</h1><p>{A}</p><figure><img src="k.jpg"><figcaption>The last kiln</figcaption></figure>
      <p>{B}</p><div class="ad-slot sponsored"><p>{AD}</p></div><p>{C}</p></article></main><div class="newsletter-signup"><p>Get our letter every week.</p>
      <form><input><button>Join</button></form></div><footer><p>Contact the editors.</p></footer></body>""",
     ["Old kilns", A, "The last kiln", B, C]),
    (f"""<body><table width="100%"><tr><td class="menu"><a href="/">Home</a><br><a href="/f">Forum</a></td><td><h2>Making a bowl</h2><p>{C}<p>{A}<p>{B}</td></tr></table>
      <div id="footer">Copyright 1999</div></body>""",
     ["Making a bowl", C, A, B]),
    (f"""<body><div id="page"><div id="masthead"><div id="site-navigation"><ul class="menu"><li><a href="/">Home</a></li></ul></div></div>
      <section class="post-body"><h1>Sand and ash</h1><p>{A}</p><ol><li>wash the sand</li><li>dry it for a day</li></ol><p>{B}</p><pre>mix = sand + ash</pre></section>
      <section id="disqus_thread" class="comment-list"><h3>Comments</h3><div class="comment"><p>{C}</p></div></section>
      <div class="related-posts"><h3>You may also like</h3><ul><li><a href="/x">Blue glass</a></li></ul></div></div></body>""",
     ["Sand and ash", A, "wash the sand", "dry it for a day", B, "mix = sand + ash"]),
    (f"""<body><div class="gdpr-banner cookie-consent"><p>This site uses cookies to improve your visit.</p><button>Accept</button></div>
      <div class="content-area"><article><header><h1>The museum</h1><div class="byline">By Jo</div></header><p>{B}</p><blockquote><p>{A}</p></blockquote><p>{C}</p></article></div>
      <aside id="secondary" class="widget-area"><h2>Archive</h2><p>{AD}</p></aside></body>""",
     ["The museum", B, A, C]),
]


def accuracy():
    model, right, total = train(PAGES), 0, 0
    for page, lines in HELD_OUT:
        got = model.text(page).split("\n")
        right += len([x for x in got if x in lines])
        total += max(len(lines), len(got)) if set(got) != set(lines) else len(lines)
    return right / total


def test_held_out_pages():
    assert accuracy() >= 0.85  # all article lines, and three lines of a table menu and a list of related posts


def test_rows_that_repeat(spark):
    rows = [(1, HELD_OUT[0][0], "u")] * 3 + [(None, HELD_OUT[1][0], None), (2, None, "u"), (2, "<p>x</p>", "u")]
    pages = spark.createDataFrame(rows, "page_id long, html string, url string").repartition(3)
    got = pages.withColumn("t", main_text(pages)).collect()
    assert len(got) == 6 and len({r.t for r in got if r.page_id == 1}) == 1
    assert sorted(r.t for r in got if r.page_id == 2) == ["", "x"]
