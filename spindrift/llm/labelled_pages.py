"""The labelled table of the HTML extraction: small pages whose blocks were judged by hand.

A block's text begins with its label: + is main text, - is not. ~N stands for N more words, so that blocks have the lengths
of real ones. Pages whose articles are marked, pages that only name a container, and pages without any mark take turns.
"""

PAGES = (
    # News site, marked article, everything around it framed.
    """<body class="single no-sidebar"><header class="site-header"><a>-Daily Courier</a></header><nav><ul><li><a>-Home</a><li><a>-World</a><li><a>-Sport</a></ul></nav>
    <article><h1>+Bridge to reopen in May</h1><p>+By Ann Lee</p><p>+The council ~40</p><p>+No.</p><p>+It said ~6 <a>in a letter</a></p><blockquote>+We are ~12</blockquote><ul><li>+first lane</li><li>+second lane</li></ul>
    <aside>-Read more <a>about ~5</a></aside><p>+Work began ~55</p><div class="ad">-Buy a car today</div><p>+<a>The full report</a></p></article>
    <section id="comments"><p>-I drive there ~30</p><p>-Me too</p></section><aside class="sidebar"><h3>-Popular</h3><p>-Ten ways ~25</p></aside><footer>-© Courier <a>Imprint</a></footer>""",
    # Marked article of one sentence.
    """<nav><a>-Start</a><a>-News</a></nav><div class="ad">-In this week only ~6</div><article><h1>+Closed</h1><p>+Shop shut.</p></article><footer>-© example.org and a sentence ~9</footer>""",
    # Marked article, long advert and long footer outside.
    """<div class="ad">-Our offer ~35</div><article><h1>+A title of some words</h1><p>+Text ~20<br>and ~3</p><p>+Ja.</p><p>+Text ~120</p><p>+Of it.</p></article><footer>-© site · we ~30</footer><div>-Stray line outside</div>""",
    # Main element, article text in plain divisions, long plain text outside.
    """<div>-Welcome to our ~14</div><main><div>+Opening hours ~4</div><div>+Monday to Friday</div><div>+We serve ~22</div><h2>+Where</h2><div>+At the port</div></main><div>-This site ~18</div><div>-Imprint</div>""",
    # Main with its own navigation and form.
    """<main><div class="breadcrumb"><a>-Home</a> / <a>-Docs</a></div><h1>+Install</h1><p>+Run the command ~9</p><pre>+make install</pre><ul><li>+<a>Guide one</a></li><li>+<a>Guide two</a></li><li>+<a>Guide three</a></li></ul><form>-Your mail address and ~12</form><p>+Then restart ~25</p></main><div class="cookie-banner">-We use cookies ~30</div>""",
    # Names of classes that only look like frames.
    """<article><div class="legal-analysis"><p>+The court ~40</p></div><div class="ad-hoc-query"><p>+Select the ~15</p><p>+Done.</p></div><div class="comment-on-ruling"><p>+The judge ~28</p></div><div class="share-buttons">-Share this on</div></article><div class="legal-notes">-Terms ~12</div>""",
    # Blog with a named container only.
    """<div class="menu"><a>-Home</a> <a>-About us</a></div><div class="entry-content"><h2>+A walk</h2><p>+We left ~33</p><p>+Rain.</p><p>+Then ~18 <a>the map</a> ~7</p><p>+More ~48</p><p>+<a>A photo of the lake</a></p></div><div class="related-posts"><h3>-You may like</h3><p><a>-Another walk in spring</a></p></div><div class="footer">-All rights reserved</div>""",
    # Named container, short text.
    """<ul><li><a>-Home</a><li><a>-Blog</a><li><a>-Shop</a></ul><div id="content"><h1>+Hello</h1><p>+It works.</p><p>+Ok then.</p></div><div>-Powered by <a>Press</a></div>""",
    # No marks at all: long paragraphs, short ones between them.
    """<div><a>-Home</a></div><div><a>-Archive</a></div><div><a>-Contact</a></div><h1>+On the use of salt</h1><p>+Salt was ~60</p><p>+No.</p><p>+It was ~44</p><p>+Ok then.</p><p>+Later ~30</p><div><a>-Previous</a> <a>-Next</a></div><div>-Copyright 2019 by <a>the author</a></div>""",
    """<table><tr><td><a>-Index</a></td><td><a>-Up</a></td></tr></table><h2>+Chapter two</h2><p>+He went ~90</p><p>+"Why?"</p><p>+"Because ~5"</p><p>+She said ~25</p><p>+Yes.</p><p>+They ~70</p><p>+The end</p><table><tr><td><a>-Index</a></td><td><a>-Down</a></td></tr></table>""",
    """<div><a>-News</a> | <a>-Mail</a> | <a>-Maps</a></div><p>+The lake lies ~28 <a>the hills</a> ~20</p><p>+Its depth ~15</p><p>+Fish ~9</p><p><a>-Lakes of the north</a></p><p><a>-Lakes of the south</a></p><p><a>-All lakes by name</a></p>""",
    # No marks, only short texts.
    """<h1>+Notice to members</h1><p>+We meet on Monday.</p><p>+Bring a pen.</p>""",
    """<div>+Hello there.</div>""",
    """<p>+Under construction</p>""",
    """<div><a>-Home</a></div><div>+Gone fishing</div>""",
    """<div><a>-Home</a></div><div><a>-Contact</a></div><p>+Back on Friday.</p><p>+Call Ann.</p>""",
    # Nothing but frames.
    """<nav><a>-Home</a><a>-All topics</a></nav><footer>-© us</footer>""",
    """<ul><li><a>-One</a><li><a>-Two</a><li><a>-Three long link here</a></ul><div class="footer">-All rights reserved by the ~12</div>""",
    """<div class="cookie-notice">-We use cookies ~40</div><div><a>-Login</a></div>""",
    # No marks, text in division after a link bar, notices framed by name only.
    """<div class="topbar"><a>-Log in</a></div><div><div><h2>+The big headline of today</h2><p>+Word ~40</p><p>+More ~30</p></div></div><div class="newsletter">-Get our letter ~18</div><div class="sidebar">-About the author ~24</div>""",
    """<div><a>-Forum</a> <a>-Rules</a> <a>-Search here</a></div><div>+Question about ~3</div><div>+How do I ~34</div><div>+Thanks</div><div>+I tried ~22</div><div><a>-Report</a> <a>-Top</a></div>""",
    # Marked article with an embedded link list that it needs, and neighbours with many links.
    """<nav><a>-A</a><a>-B</a></nav><article><h1>+Sources of the Rhine</h1><p>+It rises ~25</p><h2>+Links</h2><ul><li>+<a>Map of the source</a></li><li>+<a>Old survey, 1901</a></li></ul><nav><a>-Part one</a></nav></article>""",
    # Weak marks outside of any container.
    """<div><a>-Start</a></div><div class="banner-history"><h2>+Flags</h2><p>+A banner ~38</p><p>+It hung ~14</p></div><div class="promo-strip-inner">-Save now</div><div class="search-tips-link"><a>-Search tips</a></div>""",
    """<div class="header-image-text"><a>-Logo</a></div><p>+An old ~50</p><p>+Mill.</p><div class="notice-of-rights">-All rights</div>""",
    # Articles that end the page, with short last lines, and lines outside of them.
    """<div>-Sunny, 21 degrees</div><article><h2>+Frost</h2><p>+The vines ~60</p><p>+Nothing helped.</p><p>+So.</p></article>""",
    """<div>-The magazine for people who ~20</div><p>-Issue 12</p><article><p>+Paper ~34</p><p>+Ends.</p></article>""",
    """<article><p>+A</p><p>+B c</p><p>+<a>d e f</a></p></article>""",
    """<article><p>+One line only</p></article><p>-Printed from our site on ~8</p><p>-Have a nice day</p>""",
    """<article><h1>+Maps</h1><p>+Old ~150</p><ul><li>+<a>North</a></li><li>+<a>South</a></li><li>+<a>East</a></li><li>+<a>West</a></li></ul></article><div>-A stray block that nobody framed ~60</div>""",
    """<div>-Editor's pick ~70</div><div>-More of it ~30</div><article><h1>+Short news</h1><p>+Rain ~9</p></article><div>-Yesterday we wrote ~45</div><div>-Bye</div>""",
    """<p><a>-Skip to text</a></p><main><h1>+Timetable</h1><table><tr><td>+6:10</td><td>+Ulm</td></tr><tr><td>+7:40</td><td>+<a>Bonn</a></td></tr></table><p>+Subject to change</p></main>""",
    """<h2>-Our network</h2><p>-We run ~26</p><p><a>-Jobs</a></p><article><p>+Quote of the day:</p><blockquote>+Be ~4</blockquote><p>+<a>Source</a></p></article><p><a>-Jobs at our place</a></p>""",
    """<article><p>+<a>Link first ~12</a></p><p>+Then text ~30</p><p>+<a>Link last</a></p></article><p>-See you</p>""",
    """<main><p>+Please read ~80</p><p>+Yes</p><div class="widget">-Weather ~6</div><p>+Or no</p><div class="search-box">-Search</div></main><p>-Visits: 12345</p>""",
    """<article><div class="notice-board-history"><p>+The board ~20</p><p>+It fell.</p></div><div class="menu-of-the-day"><p>+Soup</p><p>+Fish ~4</p></div><p>+Served ~15</p></article><div class="login-hint-text">-You can ~9</div>""",
    # Unmarked pages that end in text, and unmarked pages with lists and hints.
    """<p><a>-Top</a></p><p>+The engine ~50</p><p>+Stop.</p>""",
    """<h1>+Soup</h1><ul><li>+two onions</li><li>+salt</li><li>+a litre of water</li></ul><p>+Cook ~24</p><p>+Eat.</p>""",
    """<div>+First short line</div><div>+Second line of it</div>""",
    """<div>+To whom ~3</div><div>+We hereby ~8</div><div>+Sincerely</div><div>+A. Smith</div>""",
    """<p>+Poem</p><p>+The sea ~3</p><p>+The sky ~2</p><p>+And I</p><p><a>-Next poem in the book</a></p>""",
    """<h1>+FAQ</h1><h3>+Is it free?</h3><p>+Yes.</p><h3>+Who made it?</h3><p>+Two people ~18 <a>from Kiel</a></p><p><a>-Back</a></p><p><a>-Home page of the makers</a></p>""",
    """<div class="main-content"><p>+Only this ~5</p></div><div>-Made with love</div><div>-Server time 12:00</div>""",
    """<div class="post-body"><p>+It rained ~26</p><p>+Still.</p><p>+<a>See the picture here</a></p></div><div>-Posted in <a>weather</a></div><p>-A line below ~16</p>""",
    """<div>-Slogan of the site ~6</div><div id="story"><p>+They met ~44</p><p>+"Hi."</p><p>+Fin</p></div>""",
    # Pages of a line with a link in it.
    """<p>+See <a>this page</a></p>""",
    """<p>+Moved <a>over there</a></p>""",
    """<div>+Go to <a>the list</a></div>""",
    """<p>+Read <a>the rest</a> at home</p>""",
    # Paragraphs of articles whose classes are words of frames.
    """<article><h1>+Rules</h1><p class="notice">+All must ~12</p><p>+Then ~30</p><p class="legal">+By law ~8</p><p class="alert">+Mind the step.</p><p class="copyright">+The term ~9</p></article>""",
    """<article><p class="search">+We looked ~20</p><p class="comment">+He said ~25</p><p>+End.</p></article>""",
)
