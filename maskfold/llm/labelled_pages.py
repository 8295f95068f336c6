"""Labelled pages that train the content model.

``y="1"`` marks an element whose text belongs to the article (or that only wraps it),
``y="0"`` one that doesn't; elements without the mark are like their parent.
The pages are invented; they show the usual places of menus, notices, adverts, forms and comments.
"""

WORDS = ("Rivers carve slow valleys while the hills above them wait for winter rain, and people who farm there count "
         "the days. ").strip()

PAGES = [
    f"""<html y="1"><body><nav y="0"><ul><li><a href="/a">Home</a></li><li><a href="/b">World news</a></li></ul></nav>
    <div class="ad" y="0">Buy the new kettle today. {WORDS}</div><article><h1>Valleys in winter</h1><p><b>{WORDS}<br><p>{WORDS}</p>
    <p>Rain.</p></article><footer y="0">&copy; valley.example &middot; {WORDS}</footer></body></html>""",
    f"""<html y="1"><body><header class="site-header" y="0"><div class="logo">The Valley Post</div><nav class="main-nav"><a href="/">Home</a>
    <a href="/s">Sport</a></nav></header><div class="cookie-notice" y="0"><p>We use cookies. {WORDS}</p><button>OK</button></div>
    <div id="wrapper"><main id="main"><article class="post"><header><h1>Farming the hills</h1><p class="byline meta" y="0">By A. Author</p></header>
    <div class="entry-content"><p>{WORDS}</p><h2>Counting days</h2><p>{WORDS} {WORDS}</p><ul><li>wheat</li><li>barley and rye</li></ul>
    <aside class="pull related" y="0"><h3>Related</h3><a href="/r">More hills</a></aside><p>{WORDS}</p></div>
    <footer class="post-footer" y="0"><a href="/t">tags</a></footer></article>
    <section id="comments" class="comments" y="0"><h2>3 comments</h2><article class="comment"><p>{WORDS}</p></article>
    <article class="comment"><p>I agree.</p></article><form class="comment-form"><label>Your name</label><p>Write a reply</p></form></section></main>
    <aside class="sidebar" y="0"><h3>Popular</h3><ul><li><a href="/p">Ten rivers</a></li></ul><p>{WORDS}</p></aside></div>
    <footer class="site-footer" y="0"><p>Copyright 2020. All rights reserved. {WORDS}</p></footer></body></html>""",
    f"""<html y="1"><body><div id="header" y="0"><h2>Hill Gazette</h2><ul class="menu"><li><a href="/">Start</a></li></ul></div>
    <div class="breadcrumb" y="0"><a href="/">Start</a> &gt; <a href="/w">Weather</a></div><div id="container"><div id="content"><h1>Rain</h1>
    <div class="story"><p>{WORDS}</p><blockquote>{WORDS}</blockquote><div class="advertisement" y="0"><p>{WORDS}</p></div><p>Short.</p>
    <table><tr><th>Month</th><td>Rain in mm</td></tr><tr><th>May</th><td>70</td></tr></table><p>{WORDS}</p></div></div>
    <div id="sidebar" y="0"><div class="widget"><h3>Archive</h3><p>{WORDS}</p></div></div></div>
    <div id="footer" y="0"><p>{WORDS}</p></div></body></html>""",
    f"""<html y="1"><body><div class="banner promo" y="0"><p>{WORDS}</p></div><div class="page"><div class="article-body"><h1>Bread</h1><p>{WORDS}</p>
    <figure><img src="x.png"><figcaption>A loaf on a table.</figcaption></figure><p>{WORDS} <a href="/x">flour</a> {WORDS}</p>
    <div class="share social" y="0"><a href="/f">Share</a> <span>Follow us</span></div><pre>mix 500 g</pre><p>{WORDS}</p>
    <div class="newsletter signup" y="0"><p>Get our letter. {WORDS}</p><form><label>Mail</label></form></div></div>
    <div class="comment-list" y="0"><div class="comment"><p>{WORDS}</p></div><div class="reply"><p>{WORDS}</p></div></div></div>
    <div class="copyright" y="0">&copy; {WORDS}</div></body></html>""",
    f"""<html y="1"><body><div role="banner" y="0"><p>{WORDS}</p></div><div role="navigation" y="0"><a href="/a">One</a><a href="/b">Two</a></div>
    <div role="main"><section class="text"><h2>Clouds</h2><p>{WORDS}</p><p>{WORDS}</p><dl><dt>Cirrus</dt><dd>High cloud.</dd></dl></section></div>
    <div role="complementary" y="0"><p>{WORDS}</p></div><div role="contentinfo" y="0"><p>{WORDS}</p></div></body></html>""",
    f"""<html y="1"><body><nav y="0"><p>{WORDS}</p></nav><div class="alert notice warning" y="0">{WORDS}</div><article><h1>Ships</h1><p>{WORDS}</p>
    <form y="0"><p>{WORDS}</p><fieldset><legend>Poll</legend><label>Yes</label></fieldset></form><section><h2>Sails</h2><p>{WORDS}</p><p>Ropes.</p></section>
    <div class="ads sponsor" y="0"><p>{WORDS}</p></div><nav class="toc pagination" y="0"><a href="#1">Next page</a></nav><p>{WORDS}</p></article>
    <section class="comments discussion" y="0"><h3>Readers say</h3><p>{WORDS}</p><ol class="commentlist"><li><p>{WORDS}</p></li></ol></section>
    <aside y="0"><p>{WORDS}</p></aside></body></html>""",
    f"""<html y="1"><body><header y="0"><h1>Daily Sail</h1><p>{WORDS}</p></header><main><h1>Harbours</h1><p>{WORDS}</p><div><p>{WORDS}</p><div><p>{WORDS}</p></div></div>
    <aside y="0"><p>{WORDS}</p></aside><div class="author-box bio" y="0"><p>{WORDS}</p></div></main><aside class="skyscraper" y="0"><p>{WORDS}</p></aside>
    <footer y="0"><ul><li><a href="/i">Imprint</a></li></ul><p>{WORDS}</p></footer></body></html>""",
    f"""<html y="1"><body><div class="topbar menu" y="0"><a href="/">Menu</a></div><div class="popup modal overlay" y="0"><p>Subscribe now. {WORDS}</p></div>
    <div class="row"><div class="col content"><div class="post-title"><h1>Mills</h1></div><div class="post-content"><p>{WORDS}</p><p>Wind.</p><h3>Stones</h3><p>{WORDS}</p></div>
    <div class="related-posts recommended" y="0"><h4>You may like</h4><p>{WORDS}</p></div><div id="disqus_thread" class="feedback responses" y="0"><p>{WORDS}</p></div></div>
    <div class="col side right-rail" y="0"><p>{WORDS}</p><div class="ad-slot"><p>{WORDS}</p></div></div></div><div class="bottom legal disclaimer" y="0"><p>{WORDS}</p></div></body></html>""",
    f"""<html y="1"><body><article><p>{WORDS}</p><p>Ends.</p></article><div class="ad" y="0">{WORDS}</div><div id="comments" y="0"><p>{WORDS}</p></div>
    <div class="cookie consent gdpr" y="0">{WORDS}</div><div class="form search" y="0"><form><p>Find</p></form></div></body></html>""",
    f"""<html y="1"><body><p>{WORDS}</p><p>{WORDS}</p><div><h2>Plain page</h2><p>{WORDS}</p></div><footer y="0"><p>{WORDS}</p></footer></body></html>""",
]

# Names that sites give to places beside the article, and to the article's own wrappers.
BESIDE = """menu nav navigation navbar topnav header masthead footer foot colophon sidebar side rail sidenav banner ad ads advert
advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice alert warning announcement popup modal
overlay dialog newsletter subscribe subscription signup login register search form contact comment comments commentlist respond
reply replies discussion disqus feedback review reviews share sharing social follow related recommended recommendation similar popular
trending archive tag tags category categories widget breadcrumb breadcrumbs pagination pager toolbar author bio byline meta legal
disclaimer copyright imprint privacy license skip outbrain taboola teaser sitemap links blogroll donate poll rating""".split()
WRAPPERS = """article content main post entry story text body page wrapper container column col row section inner center primary
hentry blog news document single prose markdown readable wrap layout site app root grid area block""".split()

for _k in range(0, len(BESIDE), 6):
    _beside = (BESIDE + BESIDE)[_k:_k + 6]
    _wrap = [WRAPPERS[(_k + _i) % len(WRAPPERS)] for _i in range(3)]
    _parts = [f'<div class="{_n}" y="0"><p>{WORDS}</p></div>' for _n in _beside]
    _links = "".join(f'<li><a href="/{_n}">{_n}</a></li>' for _n in (BESIDE + BESIDE)[_k:_k + 2 + _k // 6 % 9])
    _nav = f'<nav y="0"><ul>{_links}</ul></nav>'
    _foot = f'<footer y="0">&copy; site &middot; {WORDS}</footer>'
    _form = f'<form y="0"><p>{WORDS}</p><fieldset><legend>Poll</legend><p>Yes</p></fieldset></form>'
    _list = "<ul><li>wheat</li><li><a href=\"/w\">oats</a></li><li>barley and rye</li></ul>"
    PAGES.append(f"""<html y="1"><body>{_nav}{_parts[0]}<div id="{_wrap[0]}"><div class="{_wrap[1]}"><h1>Stones</h1><p>{WORDS}</p>{"".join(_parts[1:3])}
    <div class="{_wrap[2]}"><p>{WORDS}</p><h2>Sand</h2>{_list}<p>Clay.</p></div></div>{"".join(_parts[3:5])}</div>{"".join(_parts[5:])}{_foot}</body></html>""")
    PAGES.append(f"""<html y="1"><body><header y="0"><h1>Site</h1>{_nav}</header><div class="{_beside[5]}" y="0"><ul>{_links}</ul></div>{_parts[0].replace("div", "section")}<article class="{_wrap[0]}"><header><h2>Sand</h2></header>
    <section><p>{WORDS}</p>{_parts[1].replace("p>", "span>")}<p>{WORDS}</p>{_list}</section>{_form}{_parts[2].replace("div", "ul").replace("p>", "li>")}
    <aside y="0"><p>{WORDS}</p></aside></article>{_parts[3].replace("div", "aside")}<header class="{_beside[-1]}" y="0"><p>{WORDS}</p></header>{_foot}</body></html>""")
    PAGES.append(f"""<html y="1"><body>{_nav}<div class="{_beside[1]}" y="0">{WORDS}</div><article><h1>Clay</h1><p>{WORDS}</p><p>Short.</p><p><a href="/l">A link</a></p></article>
    <section class="{_beside[4]}" y="0"><h3>Ten</h3><article><p>{WORDS}</p></article></section>{_foot}</body></html>""")
