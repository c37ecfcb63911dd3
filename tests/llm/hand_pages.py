"""Pages written by hand, in styles that the made layouts don't have, with the main text of each.

None comes from the test tables or the generator that the model is fitted on; most have no
article element.
"""

P1 = "The ferry left the island before dawn, and by the time the sun rose over the bay the last of the fishing boats had already come back to the harbour with their nets half empty."
P2 = "Nobody on the quay seemed surprised. For three summers in a row the catch had grown smaller, and most families had begun to rent rooms to visitors in order to pay for fuel."
P3 = "The mayor, who used to be a fisherman himself, says that the council will publish its plan for the old cannery in the autumn, once the engineers have finished measuring the site."
P4 = "Mix the flour with the salt and make a well in the middle. Pour in the warm water little by little, stirring with a wooden spoon, until the dough comes away from the bowl."
P5 = "Leave it under a cloth for two hours. When it has doubled in size, fold it over itself four times and shape it into a loaf, then bake it in a very hot oven for forty minutes."
P6 = "A queue keeps its items in the order in which they came. Adding an item takes constant time, and so does taking one, as long as the buffer never has to be copied to a larger one."
P7 = "If several workers read from the same queue, each item is handed to exactly one of them. A worker that stops before it has confirmed an item gives it back after the timeout."
P8 = "We walked along the ridge for six hours without meeting anyone. The path is well marked down to the second hut, but after that the signs are old and easily missed in fog."
P9 = "Water is the main problem in August: the spring below the pass was dry, so carry at least three litres for each person and do not count on the stream near the shepherds' hut."

_MENU = '<div id="top-links"><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a> <a href="/weather">Weather</a> <a href="/contact">Contact us</a></div>'
_LEGAL = '<div class="legal-line">© 2021 Harbour Gazette Ltd. All rights reserved. <a href="/terms">Terms</a> <a href="/privacy">Privacy</a></div>'

PAGES: list[tuple[str, list[str]]] = [
    # A weblog of divs.
    (f'<!doctype html><html><head><title>x</title><style>p{{}}</style></head><body>{_MENU}<div class="post"><h1>Empty nets</h1><p>{P1}</p><p>{P2}</p><p>{P3}</p></div>'
     f'<div class="widget-area"><h4>Recent posts</h4><ul><li><a href="/1">Storm warning</a></li><li><a href="/2">A new pier</a></li></ul></div>{_LEGAL}</body></html>', ["Empty nets", P1, P2, P3]),
    # A news page with main, notice and comments.
    (f'<html><body><div class="cookie-banner">We use cookies to improve your experience. <button>Accept all</button></div><nav><a href="/">Start</a><a href="/local">Local</a></nav>'
     f'<main><h1>Cannery plan delayed</h1><p>{P3}</p><p>{P2}</p></main><section class="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>They have been promising this for years.</p></div>'
     f'<div class="comment"><b>Per</b><p>My father worked there until it closed.</p></div></section><footer><p>Imprint and contact</p></footer></body></html>', ["Cannery plan delayed", P3, P2]),
    # A layout table of the nineties.
    (f'<HTML><BODY BGCOLOR=white><TABLE WIDTH=100%><TR><TD COLSPAN=2><A HREF="a.htm">Index</A> | <A HREF="b.htm">Guestbook</A> | <A HREF="c.htm">Links</A></TD></TR>'
     f'<TR><TD WIDTH=120 class="menu"><A HREF="1.htm">Bread</A><BR><A HREF="2.htm">Soup</A><BR><A HREF="3.htm">Cakes</A></TD><TD><H2>White bread</H2><P>{P4}<P>{P5}</TD></TR></TABLE></BODY></HTML>', ["White bread", P4, P5]),
    # Documentation with a contents list and pager.
    (f'<html><body><header class="site-header"><span>libqueue</span><form><input name="q"><button>Search</button></form></header><div class="layout"><div class="toc"><ul><li><a href="#a">Queues</a></li>'
     f'<li><a href="#b">Workers</a></li></ul></div><div class="markdown-body"><h1>Queues</h1><p>{P6}</p><h2>Workers</h2><p>{P7}</p></div></div><div class="pager"><a href="p">Previous</a> <a href="n">Next</a></div></body></html>', ["Queues", P6, "Workers", P7]),
    # A travel report with an advert between its paragraphs and sharing links below.
    (f'<html><body><div class="masthead"><a href="/">Ridge &amp; Valley</a></div><div class="entry"><h1>Six hours alone</h1><p>{P8}</p><div class="ad-slot">Advertisement <a href="/buy">Boots 40% off</a></div><p>{P9}</p></div>'
     f'<div class="share-bar"><a href="#">Share</a><a href="#">Tweet</a><a href="#">Mail</a></div></body></html>', ["Six hours alone", P8, P9]),
    # No classes at all.
    (f'<html><body><p><a href="/">home</a> <a href="/about">about</a> <a href="/archive">archive</a></p><h1>Notes on bread</h1><p>{P4}</p><p>{P5}</p><hr><p><a href="/prev">older</a> <a href="/next">newer</a></p></body></html>', ["Notes on bread", P4, P5]),
    # Deep wrappers, and a sign-up form inside the text.
    (f'<html><body><div><div><div id="page"><div class="navbar"><ul><li><a href="/a">Shop</a></li><li><a href="/b">Stories</a></li></ul></div><div class="row"><div class="col-8"><div class="story-body"><p>{P1}</p>'
     f'<form class="newsletter-signup"><label>Get our letter every week</label><input type="email"><button>Subscribe</button></form><p>{P2}</p><p>{P3}</p></div></div><div class="col-4 sidebar"><h3>Most read</h3><ol><li><a href="/1">Pier closed</a></li></ol></div></div></div></div></div></body></html>', [P1, P2, P3]),
    # An article element with a header, a figure's caption and related links in it.
    (f'<html><body><article><h1>Water in August</h1><p>{P9}</p><blockquote>{P8}</blockquote><aside><h4>Related</h4><ul><li><a href="/x">Huts in winter</a></li></ul></aside></article>'
     f'<div class="promo">Join now and save! <a href="/join">Become a member</a></div></body></html>', ["Water in August", P9, P8]),
    # A list as the main text.
    (f'<html><body><nav><ul><li><a href="/">Start</a></li><li><a href="/r">Recipes</a></li></ul></nav><div id="content"><h1>Bread in two steps</h1><ol><li>{P4}</li><li>{P5}</li></ol></div><div id="footer">Made by hand in 2019</div></body></html>', ["Bread in two steps", P4, P5]),
    # A discussion below a short text, with replies that are longer than it.
    (f'<html><body><div class="topbar"><a href="/">Log in</a> <a href="/new">Register</a></div><div class="article-text"><p>{P6}</p><p>{P7}</p></div><ul class="commentlist"><li><cite>Eve</cite><div>{P8} I have seen it.</div></li><li><cite>Max</cite><div>Thanks for this, it helped me a lot when I wrote mine last year.</div></li></ul></body></html>', [P6, P7]),
    # Another script and language.
    ('<html><body><div class="menu"><a href="/">Головна</a><a href="/n">Новини</a></div><div class="text"><h1>Порожні сіті</h1><p>Пором відійшов від острова до світанку, і коли сонце піднялося над затокою, останні човни вже повернулися до гавані з напівпорожніми сітями.</p></div><div class="copyright">Усі права захищено</div></body></html>',
     ["Порожні сіті", "Пором відійшов від острова до світанку, і коли сонце піднялося над затокою, останні човни вже повернулися до гавані з напівпорожніми сітями."]),
    # Unclosed paragraphs, hidden text and character references.
    (f'<html><body><div class=header><a href=/>Caf&eacute; Gazette</a></div><div class=body><p>{P1}<p>Caf&eacute; owners &amp; fishermen met on Monday to talk about the season, the prices &#8212; and about what comes after them.<p style="display:none">hidden words<p>{P2}</div><script>var a = "<p>no</p>";</script></body></html>',
     [P1, "Café owners & fishermen met on Monday to talk about the season, the prices — and about what comes after them.", P2]),
]
